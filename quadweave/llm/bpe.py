"""Byte-level BPE over a rank file: encoding with offsets, and decoding.

A rank file lists byte strings with their ids, where a lower id means an earlier merge.  The tokenizers
library wants the same vocabulary spelt in printable characters, one for each byte, with explicit merges;
`ByteBpe` derives both, so that the library's ids equal those that the ranks define.

Texts are cut by the pre-token pattern, each distinct pre-token is encoded once by the library and kept in
a bounded worker cache, and a text's ids are the concatenation of what its pre-tokens gave.  That keeps
memory bounded by the batch and the cache, whatever the length of a text.

Defined results: a null text counts as empty; an empty text has no tokens, and the digests of nothing.
Repeated rows give repeated rows.  Extra columns are ignored by `encode`, which keeps the named key columns.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.scratch import released, small_batches

#: Distinct pre-tokens that a Python worker keeps; each takes about 250 bytes.
CACHE_ENTRIES = 160_000
#: Characters of text whose pre-tokens are held as Python strings at a time.
SLICE_CHARS = 250_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, spare = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def library_model(ranks: dict[bytes, int]):
    """A tokenizers.Tokenizer that merges by rank: every way to split a token into two tokens is a merge."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel; idle threads cost memory
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    spelt = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((spelt[left], spelt[right]))
    vocabulary = {spelt[token]: rank for token, rank in ranks.items()}
    # A pre-token that is itself a token is taken whole, as rank-based encoders do.
    model = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return model


class ByteBpe:
    """Encoder and decoder of one rank file; made once in each Python worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.library = library_model(ranks)
        self.cut = regex.compile(pattern).finditer
        self.pieces = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Decoding goes through the spelt vocabulary, back by the byte table.
        back = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for spelt, rank in self.library.get_vocab().items():
            self.bytes_of[rank] = bytes(back[c] for c in spelt)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

    def _ids(self, pieces: list[str]) -> bytes:
        """Ids of the pieces in turn, as little-endian unsigned 32-bit integers."""
        cache = self.cache
        missing = set(pieces).difference(cache)
        if missing and len(cache) + len(missing) > CACHE_ENTRIES // 2:
            # What is looked up again moves on from the older half; the rest goes with it.
            self.older, self.cache = cache, {}
            cache, missing = self.cache, set(pieces)
        if missing:
            older, fresh = self.older, []
            for piece in missing:
                if piece in older:
                    cache[piece] = older[piece]
                else:
                    fresh.append(piece)
            for piece, got in zip(fresh, self.library.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
                cache[piece] = np.array(got.ids, "<u4").tobytes()
        return b"".join(map(cache.__getitem__, pieces))

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """Ids of a text, some pre-tokens at a time."""
        if len(text) <= SLICE_CHARS:
            yield self._ids(self.pieces(text))
            return
        held, size = [], 0
        for match in self.cut(text):
            held.append(match.group())
            size += len(held[-1])
            if size >= SLICE_CHARS:
                yield self._ids(held)
                held, size = [], 0
        yield self._ids(held)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_parts(text)), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of the tokens; a character that tokens share comes whole once its last token is there."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text piece by piece: bytes of a character cut by a token border wait for the next token."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := decoder.decode(self.bytes_of[i]):
                yield piece
        if rest := decoder.decode(b"", True):
            yield rest

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Start and end of each token in characters; tokens that share a character all cover it."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        data = np.frombuffer(text.encode(), np.uint8)
        number = np.cumsum((data & 0xC0) != 0x80)  # of characters begun up to and with each byte
        return np.stack([number[starts] - 1, number[ends - 1]], 1) if len(ids) else np.zeros((0, 2), np.int64)


_made: dict[tuple[str, str], ByteBpe] = {}


def worker_bpe(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBpe(path, pattern)
    return _made[path, pattern]


def _bound(run, path: str, pattern: str):
    """Gives a task the worker's encoder, and empties its caches at the task's end: workers serve other steps too."""

    def whole(batches):
        bpe = worker_bpe(path, pattern)
        try:
            for batch in batches:
                yield from run(bpe, batch)
        finally:
            bpe.cache, bpe.older = {}, {}

    return released(whole)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    for value in batch.column(column):
        yield value.as_py() or ""


def _apart(keys: list[str], *added: str) -> None:
    if clash := {k.lower() for k in keys} & set(added):
        raise ValueError(f"key columns are called like added ones: {sorted(clash)}")


def encode(df: DataFrame, path: str, pattern: str, keys: list[str], text: str = "text") -> DataFrame:
    """`keys`, `ids` (array<int>) and `offsets` (array<struct<start,end>>, characters) of every row.

    Keys may not be called like the added columns."""
    _apart(keys, "ids", "offsets")

    def run(bpe, batch):
        for i, value in enumerate(_texts(batch, "__text")):
            ids = bpe.encode(value)
            spans = bpe.offsets(value, ids)
            row = {k: batch.column(k).slice(i, 1) for k in keys}
            pairs = pa.StructArray.from_arrays([pa.array(spans[:, 0], pa.int32()), pa.array(spans[:, 1], pa.int32())], ["start", "end"])
            row["ids"] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids.astype(np.int32)))
            row["offsets"] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pairs)
            yield pa.RecordBatch.from_pydict(row)

    small_batches(df.sparkSession)
    kept = df.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    return kept.mapInArrow(_bound(run, path, pattern), f"{schema}, ids array<int>, offsets array<struct<start:int,end:int>>")


def decode(df: DataFrame, path: str, pattern: str, keys: list[str], ids: str = "ids") -> DataFrame:
    """`keys` and `bytes` of every row of ids; null ids decode to nothing. No key may be called `bytes`."""
    _apart(keys, "bytes")

    def run(bpe, batch):
        got = [bpe.decode(value.as_py() or ()) for value in batch.column("__ids")]
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keys} | {"bytes": pa.array(got, pa.binary())})

    small_batches(df.sparkSession)
    kept = df.select(*keys, F.col(ids).alias("__ids"))
    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    return kept.mapInArrow(_bound(run, path, pattern), f"{schema}, bytes binary")


def round_trip_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes its ids, and keeps the number of tokens and a digest of either side.

    Ids and bytes go through the digests part by part, so that a long text is never held whole as ids.
    """

    def run(bpe, batch):
        counts, of_ids, of_bytes = [], [], []
        for value in _texts(batch, "__text"):
            ids_digest, bytes_digest, n = hashlib.sha256(), hashlib.sha256(), 0
            for part in bpe.encode_parts(value):
                ids_digest.update(part)
                bytes_digest.update(bpe.decode(np.frombuffer(part, "<u4").tolist()))
                n += len(part) // 4
            counts.append(n)
            of_ids.append(ids_digest.hexdigest())
            of_bytes.append(bytes_digest.hexdigest())
        yield pa.RecordBatch.from_pydict({key: batch.column(key), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": of_ids, "decoded_sha256": of_bytes})

    small_batches(df.sparkSession)
    kept = df.select(key, F.col(text).alias("__text"))
    kind = kept.schema[key].dataType.simpleString()
    return kept.mapInArrow(_bound(run, path, pattern), f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenised(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_tokens`, `ids`, and whether the ids decode to the bytes of the text, for every row."""

    def run(bpe, batch):
        for at in range(0, batch.num_rows, 256):  # ids of a few hundred texts at a time
            part = batch.slice(at, 256)
            found, same = [], []
            for value in _texts(part, "__text"):
                ids = bpe.encode(value)
                found.append(ids.astype(np.int32))
                same.append(bpe.decode(ids.tolist()) == value.encode())
            sizes = np.array([len(ids) for ids in found], np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(sizes), ids, pa.array(same, pa.bool_())], [key, "n_tokens", "ids", "lossless"])

    small_batches(df.sparkSession)
    kept = df.select(key, F.col(text).alias("__text"))
    kind = kept.schema[key].dataType.simpleString()
    return kept.mapInArrow(_bound(run, path, pattern), f"`{key}` {kind}, n_tokens bigint, ids array<int>, lossless boolean")
