"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items are compared as 64-bit hashes.  Five-word seeds that both share pick
the pairs of document and item (an item of fewer words is one seed), as tiles of five words and more cannot cover enough of an item
unless so many of its places are seeds of the document; each pair is tiled: the longest match of unmarked words is marked on both
sides, then the next, down to five words.  Matches of a length are found by running Karp-Rabin hashes.  Tiles
do not overlap and may come in any order, so that reordered passages are covered.  An item is leaked by a
document if tiles cover at least `coverage` of its words.

The benchmark is broadcast while its texts are below `BROADCAST_BYTES`, which is checked; beyond that, seeds
of both sides are joined by a shuffle.  Both ways give the same rows.

Defined results: null and empty texts match nothing; items of fewer than five words are found whole; rows
without key on either side take no part.  Rows that share a doc_id are reported each.  Equal items are
reported each.  An empty table on either side gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.kernels import shingles, word_slices
from quadweave.llm.scratch import released, small_batches, written

LEAST_WORDS = 5
COVERAGE = 0.5
BROADCAST_BYTES = 16 << 20
U = np.uint64
_STEP = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2^64
_BACK = pow(_STEP, -1, 1 << 64)


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` words."""
    n = len(words)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, U(_STEP))]))
        down = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, U(_BACK))]))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(words * up[:n])])
        return (sums[size:] - sums[:-size]) * down[: n - size + 1]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows without a marked word."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(marked)])
    return np.flatnonzero(sums[size:] == sums[:-size])


def _same(a: np.ndarray, i: int, am: np.ndarray, b: np.ndarray, j: int, bm: np.ndarray, size: int) -> int:
    """How far a match of `size` words goes on over unmarked words."""
    room = min(len(a) - i, len(b) - j) - size
    i, j = i + size, j + size
    differ = (a[i : i + room] != b[j : j + room]) | am[i : i + room] | bm[j : j + room]
    stop = np.flatnonzero(differ)
    return size + (int(stop[0]) if len(stop) else room)


def tile(document: np.ndarray, item: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(place in document, place in item, words) of the tiles, longest first."""
    tiles: list[tuple[int, int, int]] = []
    in_document, in_item = np.zeros(len(document), bool), np.zeros(len(item), bool)
    size = min(len(document), len(item))
    while size >= least:
        starts_d, starts_i = _free(in_document, size), _free(in_item, size)
        found: list[tuple[int, int, int]] = []
        if len(starts_d) and len(starts_i):
            of_d, of_i = _runs(document, size)[starts_d], _runs(item, size)[starts_i]
            hit = np.flatnonzero(np.isin(of_d, of_i))
            if len(hit):
                order = np.argsort(of_i, kind="stable")
                lo, hi = np.searchsorted(of_i[order], of_d[hit]), np.searchsorted(of_i[order], of_d[hit], "right")
                ends: dict[int, int] = {}  # by diagonal: how far the last match there went
                for h, a, b in zip(hit, lo, hi, strict=True):
                    d = int(starts_d[h])
                    for place in order[a:b]:
                        i = int(starts_i[place])
                        if ends.get(d - i, -1) > d or not np.array_equal(document[d : d + size], item[i : i + size]):
                            continue
                        length = _same(document, d, in_document, item, i, in_item, size)
                        ends[d - i] = d + length
                        found.append((length, d, i))
        if found and max(found)[0] > 2 * size:
            size = max(found)[0]
            continue
        rest = sorted(found, key=lambda m: (-m[0], m[1], m[2]))
        again = False
        for length, d, i in rest:
            if in_document[d : d + length].any() or in_item[i : i + length].any():
                again = True  # what is left of it is looked for once more
                continue
            in_document[d : d + length] = in_item[i : i + length] = True
            tiles.append((d, i, length))
        if again:
            continue
        size = least if least < size < 2 * least else size // 2
    return sorted(tiles, key=lambda t: (-t[2], t[0]))


def _least(n: int) -> int:
    """Words of a seed, and of the shortest tile, for an item of n words."""
    return min(LEAST_WORDS, n)


def _fewest(n: int, coverage: float) -> int:
    """Places of an item of n words at which seeds begin that a document has at least, if tiles cover enough: one for every five words."""
    return max(1, int(np.ceil(coverage * n / LEAST_WORDS - 1e-9)))


def _seeds(own: np.ndarray, size: int) -> np.ndarray:
    return shingles(own, size) if len(own) >= size else np.zeros(0, U)


def _items(ids: list, texts: pa.Array):
    """Words by item, the sorted seeds with their items, one for each place, and the lengths of seeds that occur."""
    words, seeds, owners, sizes = [], [], [], set()
    for i, j, hashes, bounds, _ in word_slices(texts):
        for r in range(j - i):
            own = hashes[bounds[r] : bounds[r + 1]]
            words.append(own)
            if len(own):
                sizes.add(_least(len(own)))
                seeds.append(shingles(own, _least(len(own))))
                owners.append(np.full(len(seeds[-1]), len(words) - 1))
    if not seeds:
        return ids, words, np.zeros(0, U), np.zeros(0, np.int64), []
    seeds, owners = np.concatenate(seeds), np.concatenate(owners)
    order = np.argsort(seeds, kind="stable")
    return ids, words, seeds[order], owners[order], sorted(sizes)


_SCHEMA = "doc_id bigint, item_id bigint, n_tiles int, covered_words bigint, item_words bigint, coverage double, tiles array<struct<doc_word:bigint,item_word:bigint,words:bigint>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tiles", pa.int32()), ("covered_words", pa.int64()), ("item_words", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())])))])


def _row(doc_id, item_id, document: np.ndarray, item: np.ndarray, coverage: float) -> dict | None:
    tiles = tile(document, item, _least(len(item)))
    covered = sum(t[2] for t in tiles)
    if not tiles or covered < coverage * len(item):
        return None
    return {"doc_id": doc_id, "item_id": item_id, "n_tiles": len(tiles), "covered_words": covered, "item_words": len(item), "coverage": covered / len(item), "tiles": [{"doc_word": d, "item_word": i, "words": n} for d, i, n in tiles]}


def _near(document: np.ndarray, seed_at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a document that lie in a seed; runs of others shrink to one word that matches nothing."""
    inside = np.zeros(len(document) + 1, np.int64)
    np.add.at(inside, seed_at, 1)
    np.add.at(inside, np.minimum(seed_at + sizes, len(document)), -1)
    inside = np.cumsum(inside)[:-1] > 0
    first = ~inside & np.concatenate([[True], inside[:-1]])
    return np.flatnonzero(inside | first), inside


def leaks(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document and item that it leaks, with the tiles in word positions."""
    small_batches(documents.sparkSession)
    docs = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("bigint").alias("item_id"), F.col(item_text).alias("item"))
    size = items.agg(F.sum(F.octet_length("item") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        return _by_broadcast(docs, items, coverage)
    return _by_shuffle(docs, items, coverage)


def _by_broadcast(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    table = items.toArrow()  # below BROADCAST_BYTES
    shared = docs.sparkSession.sparkContext.broadcast(_items(table["item_id"].to_pylist(), table["item"].combine_chunks()))

    def run(batches):
        ids, words, seeds, owners, lengths = shared.value
        fewest = np.array([_fewest(len(w), coverage) for w in words], np.int64)
        for batch in batches:
            out = []
            for i, j, hashes, bounds, _ in word_slices(batch.column(1)):
                if not len(seeds):
                    break
                for r in range(j - i):
                    document = hashes[bounds[r] : bounds[r + 1]]
                    begins, sizes, values = [], [], []
                    for size in lengths:
                        own = _seeds(document, size)
                        at = np.minimum(np.searchsorted(seeds, own), len(seeds) - 1)
                        hit = np.flatnonzero(seeds[at] == own)
                        begins.append(hit)
                        sizes.append(np.full(len(hit), size))
                        values.append(own[hit])
                    begins, values = np.concatenate(begins), np.unique(np.concatenate(values))
                    if not len(begins):
                        continue
                    # Places of every item that are seeds of the document.
                    of = np.concatenate([owners[np.searchsorted(seeds, v) : np.searchsorted(seeds, v, "right")] for v in values])
                    touched, places = np.unique(of, return_counts=True)
                    touched = touched[places >= fewest[touched]]
                    if not len(touched):
                        continue
                    kept, inside = _near(document, begins, np.concatenate(sizes))
                    short = np.where(inside[kept], document[kept], U(0))
                    for o in touched:
                        if found := _row(batch.column(0)[i + r].as_py(), ids[o], short, words[o], coverage):
                            for t in found["tiles"]:
                                t["doc_word"] = int(kept[t["doc_word"]])
                            out.append(found)
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return docs.mapInArrow(released(run), _SCHEMA)


def _seed_rows(lengths: list[int] | None):
    """(id, n, seed, places): n words of the text, places at which the seed begins; of items by their own length of seeds."""

    def run(batches):
        for batch in batches:
            for i, j, hashes, bounds, _ in word_slices(batch.column(1)):
                for r in range(j - i):
                    own = hashes[bounds[r] : bounds[r + 1]]
                    found = np.concatenate([np.zeros(0, U), *(_seeds(own, size) for size in ([_least(len(own))] if lengths is None else lengths) if size)])
                    seeds, places = np.unique(found, return_counts=True)
                    same = [np.full(len(seeds), x, np.int64) for x in (batch.column(0)[i + r].as_py(), len(own))]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(seeds.view(np.int64)), pa.array(places.astype(np.int64))], ["id", "n", "seed", "places"])

    return run


_SEEDS = "id bigint, n bigint, seed bigint, places bigint"


def _by_shuffle(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    of_items = written(items.mapInArrow(_seed_rows(None), _SEEDS).select(F.col("id").alias("item_id"), "n", "seed", "places"), "seeds")
    lengths = sorted(r["size"] for r in of_items.select(F.least("n", F.lit(LEAST_WORDS)).alias("size")).distinct().collect())  # LEAST_WORDS rows at most
    of_docs = docs.mapInArrow(_seed_rows(lengths), _SEEDS).select(F.col("id").alias("doc_id"), "seed").distinct()
    # Rows that share an id are counted together, which leaves no pair out.
    fewest = F.greatest(F.lit(1), F.ceil(coverage * F.min("n") / LEAST_WORDS - F.lit(1e-9)))
    pairs = of_docs.join(of_items, "seed").groupBy("doc_id", "item_id").agg(F.sum("places").alias("places"), fewest.alias("fewest"))
    pairs = written(pairs.where("places >= fewest").select("doc_id", "item_id"), "pairs")

    def run(batches):
        for batch in batches:
            sides = []
            for name in ("text", "item"):
                sides.append([hashes[bounds[r] : bounds[r + 1]] for i, j, hashes, bounds, _ in word_slices(batch.column(name)) for r in range(j - i)])
            rows = [_row(d, i, a, b, coverage) for d, i, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(), *sides, strict=True) if len(b)]
            yield pa.RecordBatch.from_pylist([r for r in rows if r], _ARROW)

    return pairs.join(docs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "item").mapInArrow(run, _SCHEMA)
