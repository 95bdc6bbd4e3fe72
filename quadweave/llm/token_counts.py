"""Token counts by a two-tier lookup, without moving pre-tokens between executors.

The first tier is a table of frequent pre-tokens with their lengths in tokens, broadcast to every worker as a few numpy arrays: sorted
hashes, lengths of one byte, and the pre-tokens' bytes, by which a hit is confirmed.  Its size is fixed (`TABLE_ENTRIES`).  The second
tier is a bounded cache of each worker: what is met for the first time is looked up in the table, all such pre-tokens of a text at
once, and what the table lacks is encoded by the library.  The tiers decide only how fast a length is found, never which.

Which pre-tokens are frequent is told by a bounded sample: about `SAMPLE_ROWS` texts of at most `SAMPLE_BYTES`, chosen by a hash of key and text.
No pre-token of a text leaves its task, and the plan has no shuffle.

Defined results: a null text counts as empty, with no bytes and no tokens.  Repeated rows give repeated rows.  Extra columns are ignored,
a key may be called like any column of the result but for those that it would hide, which is an error.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.scratch import small_batches

TABLE_ENTRIES = 32_768
SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 1 << 16
CACHE_ENTRIES = 300_000
SLICE_CHARS = 1_000_000
#: The pre-token pattern of byte-level tokenizer files (a fixed value of that format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Lengths(dict):
    """Lengths of pre-tokens; what is unknown counts as nothing and is noted."""

    def __init__(self):
        super().__init__()
        self.missing: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.missing.append(piece)
        return 0


class Table:
    """Pre-tokens and their lengths as arrays, which are pickled and held as they are."""

    def __init__(self, lengths: dict[str, int]):
        known = {p.encode(): n for p, n in lengths.items() if n < 256}
        rows = sorted((xxhash.xxh3_64_intdigest(p), p, n) for p, n in known.items())
        self.hashes = np.array([h for h, _, _ in rows], np.uint64)
        self.lengths = np.array([n for _, _, n in rows], np.uint8)
        self.ends = np.cumsum([0, *(len(p) for _, p, _ in rows)]).astype(np.int32)
        self.bytes = b"".join(p for _, p, _ in rows)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, pieces: list[str]) -> list[int | None]:
        """The length of each pre-token that the table has."""
        if not len(self):
            return [None] * len(pieces)
        coded = [p.encode() for p in pieces]
        hashes = np.array([xxhash.xxh3_64_intdigest(p) for p in coded], np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        same = self.hashes[at] == hashes
        return [int(self.lengths[i]) if hit and self.bytes[self.ends[i] : self.ends[i + 1]] == p else None for i, hit, p in zip(at.tolist(), same.tolist(), coded, strict=True)]


class JsonCounter:
    """Counts of a byte-level tokenizer file; files of other kinds are counted text by text."""

    def __init__(self, path: str, table: Table):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel; idle threads cost memory
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, pre = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) and not a["normalized"] for a in added)
        self.by_piece = plain and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        specials = sorted((a["content"] for a in added), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.pieces, self.cut = regex.compile(BYTE_LEVEL_PATTERN).findall, regex.compile(BYTE_LEVEL_PATTERN).finditer
        self.pieces_only = Tokenizer.from_file(path)
        self.pieces_only.no_padding()
        self.pieces_only.no_truncation()
        if self.by_piece:
            self.pieces_only.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table, self.lengths = table, _Lengths()

    def _count_pieces(self, pieces: list[str]) -> int:
        lengths = self.lengths
        total = sum(map(lengths.__getitem__, pieces))
        if lengths.missing:
            missed = Counter(lengths.missing)
            lengths.missing = []
            if len(lengths) + len(missed) > CACHE_ENTRIES:
                self.lengths = lengths = _Lengths()
            fresh = []
            for piece, n in zip(missed, self.table.find(list(missed)), strict=True):
                if n is None:
                    fresh.append(piece)
                else:
                    lengths[piece] = n
            for piece, got in zip(fresh, self.pieces_only.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
                lengths[piece] = len(got)
            total += sum(n * lengths[piece] for piece, n in missed.items())
        return total

    def _count_plain(self, text: str) -> int:
        if len(text) <= SLICE_CHARS:
            return self._count_pieces(self.pieces(text))
        total, held, size = 0, [], 0
        for match in self.cut(text):
            held.append(match.group())
            size += len(held[-1])
            if size >= SLICE_CHARS:
                total, held, size = total + self._count_pieces(held), [], 0
        return total + self._count_pieces(held)

    def count(self, text: str) -> int:
        if not self.by_piece:
            return len(self.library.encode(text, add_special_tokens=False))
        if self.specials is None or not self.specials.search(text):
            return self._count_plain(text)
        total, at = 0, 0
        for match in self.specials.finditer(text):  # each is one token, and cuts what stands around it
            total += self._count_plain(text[at : match.start()]) + 1
            at = match.end()
        return total + self._count_plain(text[at:])


class PieceCounter:
    """Counts of a sentencepiece model, text by text: its pieces cross word borders, so no table applies."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1))


def frequent_lengths(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", entries: int = TABLE_ENTRIES) -> Table:
    """The table of the first tier: at most `entries` pre-tokens with their lengths."""
    import regex

    counter = JsonCounter(path, Table({}))
    if not counter.by_piece:
        return Table({})
    rows = df.select(F.col(text).alias("text"), F.xxhash64(key, text).alias("place")).where(F.octet_length("text") <= SAMPLE_BYTES)
    pieces, cut = Counter(), regex.compile(BYTE_LEVEL_PATTERN).findall
    for row in rows.orderBy("place").limit(SAMPLE_ROWS).select("text").toLocalIterator():
        pieces.update(cut(row["text"]))
    kept = sorted(pieces, key=lambda p: (-pieces[p], p))[:entries]
    return Table({piece: len(got) for piece, got in zip(kept, counter.pieces_only.encode_batch_fast(kept, add_special_tokens=False), strict=True)})


_made: dict[str, tuple[str, object]] = {}


def _worker_counter(path: str, table, run_id: str) -> JsonCounter | PieceCounter:
    """The worker's counter of a run: caches live as long as tasks of the same run come."""
    if path not in _made or _made[path][0] != run_id:
        _made[path] = run_id, PieceCounter(path) if path.endswith(".model") else JsonCounter(path, table.value)
    return _made[path][1]


def token_counts(df: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_bytes` (UTF-8), `n_tokens` and `over_limit` of every row."""
    if key.lower() in ("n_bytes", "n_tokens", "over_limit", "__text"):
        raise ValueError(f"the key {key} is called like a column of the result")
    small_batches(df.sparkSession)
    table = Table({}) if path.endswith(".model") else frequent_lengths(df, path, key, text)
    shared, run_id = df.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex

    def run(batches):
        counter = _worker_counter(path, shared, run_id)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column("__text"):
                value = value.as_py() or ""
                sizes.append(len(value.encode()))
                counts.append(counter.count(value))
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([n > limit for n in counts], pa.bool_())})

    kept = df.select(key, F.col(text).alias("__text"))
    kind = kept.schema[key].dataType.simpleString()
    return kept.mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
