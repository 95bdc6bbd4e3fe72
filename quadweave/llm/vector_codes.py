"""Compressing vectors to codes of product codebooks; nearest entries are found by GNAT, exactly.

Components become integers, vectors are cut into equal parts, and each part position has a codebook, fitted by rounds of
assigning every part of every row to its nearest entry and replacing entries by the floored means of their parts.  All is integer
arithmetic, so the result does not depend on how rows are dealt to tasks.

The index is a geometric near-neighbour access tree over the entries of one codebook: a node has a few split points, every other
entry belongs to its nearest split point, and for each pair (split point i, child j) the node stores the range of distances from i
to the entries of j.  A query that is d away from split point i and knows an entry within r cannot find a nearer one in child j if
d + r is below the range, or d - r above it, so j falls with all that is below it.  Distances of the ranges are widened, r is rounded
up, and only strictly worse children fall; what remains is compared by integer squared distances, ties by entry number.

A task holds an Arrow batch and the codebooks; it hands on one row of sums for each entry that it met, and the driver
gets `entries` rows a part.

Defined results: rows take no part whose vector is null or holds a null or non-finite component, nor rows whose vector cannot be cut
into equal parts or is of another length than that of the smallest id.  Rows without id are coded, but found no codebook
entry.  Rows that share an id stand in the order of their vectors, and repeated rows count each.  With fewer rows than `entries` the
codebooks are smaller.  Errors and their sums beyond a long are held at its limits.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.scratch import released, small_batches, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Split points of a node, and entries up to which a node is a leaf.
SPLITS = 8
LEAF = 12
#: Labels up to which their sums are broadcast.
BROADCAST_LABELS = 1_000_000
_TOP = 2**63 - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all pairs: by floating point while every sum stays below 2^53, else by whole numbers of any size."""
    most = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 4 * most * most * a.shape[1] < 2**53:
        a, b = a.astype(np.float64), b.astype(np.float64)
        return ((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    a, b = a.astype(object), b.astype(object)
    return ((a[:, None, :] - b[None]) ** 2).sum(2)


class Gnat:
    """Nearest entries of a codebook, with the number of distances that the searches have computed."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS, leaf: int = LEAF):
        self.entries, self.splits, self.leaf = entries, splits, leaf
        self.computed = 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray):
        """(split points, children, low, high) of some entries, or just the entries of a leaf."""
        points = self.entries[members]
        if len(members) <= self.leaf:
            return members
        chosen = [0]  # farthest-first
        gaps = squared(points, points[:1])
        while len(chosen) < self.splits and gaps.min(1).max() > 0:
            chosen.append(int(gaps.min(1).argmax()))
            gaps = np.concatenate([gaps, squared(points, points[chosen[-1:]])], 1)
        if len(chosen) < 2:
            return members  # all entries are equal
        to = gaps.argmin(1)
        to[chosen] = np.arange(len(chosen))
        far = np.sqrt(gaps.astype(np.float64))
        low, high = np.zeros((len(chosen), len(chosen))), np.zeros((len(chosen), len(chosen)))
        children = []
        for j in range(len(chosen)):
            own = to == j
            low[:, j], high[:, j] = far[own].min(0) * (1 - 1e-12), far[own].max(0) * (1 + 1e-12)
            own[chosen[j]] = False
            children.append(self._node(members[own]) if own.any() else None)
        return members[chosen], children, low, high

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every query."""
        # Equal queries are searched once; a third of all rows may be alike.
        alike, back = np.unique(queries, axis=0, return_inverse=True) if len(queries) else (queries, np.zeros(0, np.int64))
        small = float(max(np.abs(alike).max(initial=0), np.abs(self.entries).max(initial=0))) ** 2 * 4 * alike.shape[1] < 2**63
        best = np.full(len(alike), _TOP if small else 1 << 300, np.int64 if small else object)
        place = np.full(len(alike), len(self.entries), np.int64)
        self._search(self.root, alike, np.arange(len(alike)), best, place)
        return place[back.reshape(-1)], best[back.reshape(-1)]

    def _take(self, entries: np.ndarray, gaps: np.ndarray, rows: np.ndarray, best: np.ndarray, place: np.ndarray) -> None:
        """Keeps, for each row, the nearer of what it has and the nearest of some entries in ascending order."""
        order = np.argsort(entries)
        at = gaps[:, order].argmin(1)  # the first of equals
        gap, entry = gaps[:, order][np.arange(len(rows)), at], entries[order][at]
        better = (gap < best[rows]) | ((gap == best[rows]) & (entry < place[rows]))
        best[rows[better]], place[rows[better]] = gap[better], entry[better]

    def _search(self, node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, place: np.ndarray) -> None:
        if not len(rows):
            return
        entries = node if isinstance(node, np.ndarray) else node[0]
        gaps = squared(queries[rows], self.entries[entries])
        self.computed += gaps.size
        self._take(entries, gaps, rows, best, place)
        if isinstance(node, np.ndarray):
            return
        _, children, low, high = node
        far = np.sqrt(gaps.astype(np.float64))
        own = gaps.argmin(1)
        for turn in (True, False):  # first the child of the nearest split point, then the others, with what is known by then
            for j, child in enumerate(children):
                if child is None:
                    continue
                mine = np.flatnonzero((own == j) == turn)
                reach = np.sqrt(best[rows[mine]].astype(np.float64)) * (1 + 1e-12)
                slack = 1e-12 * far[mine]
                outside = (far[mine] + slack + reach[:, None] < low[:, j]) | (far[mine] - slack - reach[:, None] > high[:, j])
                self._search(child, queries, rows[mine[~outside.any(1)]], best, place)


def whole_components(df: DataFrame, vector: str, scale: int, *columns) -> DataFrame:
    """`columns` and vec, the floored multiples of every component; rows whose vector is not whole are left out."""
    x = F.col(vector).cast("array<double>")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(sound).select(*columns, F.transform(x, lambda v: F.floor(scale * v)).alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.int64)


def _sums(shared):
    """Of each part position and entry: how many parts are nearest to it, and their sums by component."""

    def run(batches):
        trees = [Gnat(book) for book in shared.value]
        totals = [np.zeros((len(book), book.shape[1] + 1), object) for book in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.split(_matrix(batch.column("vec")), len(trees), axis=1)
            for tree, total, rows in zip(trees, totals, parts, strict=True):
                place, _ = tree.nearest(rows)
                order = np.argsort(place, kind="stable")
                met, first = np.unique(place[order], return_index=True)
                total[met, 0] += np.diff(np.append(first, len(order)))
                total[met, 1:] += np.add.reduceat(rows[order].astype(object if np.abs(rows).max() > 2**40 else np.int64), first, axis=0)
        for part, total in enumerate(totals):
            met = np.flatnonzero(total[:, 0])
            columns = [pa.array(np.full(len(met), part, np.int32)), pa.array(met.astype(np.int32))]
            columns += [pa.array([int(v) for v in c], pa.decimal128(38, 0)) for c in total[met].T]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *(f"s{i}" for i in range(total.shape[1] - 1))])

    return run


def _codes(shared):
    def run(batches):
        trees = [Gnat(book) for book in shared.value]
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, len(trees)), np.int64), np.zeros(batch.num_rows, object)
            if batch.num_rows:
                for i, rows in enumerate(np.split(_matrix(batch.column("vec")), len(trees), axis=1)):
                    codes[:, i], gaps = trees[i].nearest(rows)
                    errors += gaps
            text = ["".join(f"{c:02x}" for c in code) for code in codes]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array([min(int(e), _TOP) for e in errors], pa.int64())], ["id", "label", "code", "error"])

    return run


def fit(rows: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after some rounds over all rows (of column vec), from the vectors in `first`."""
    books = np.split(first, parts, axis=1)
    width = books[0].shape[1]
    sums = [f"s{i}" for i in range(width)]
    kind = "part int, entry int, " + ", ".join(f"{c} decimal(38,0)" for c in ["n", *sums])
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)
        total = rows.select("vec").mapInArrow(released(_sums(shared)), kind).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *sums]))
        books = [book.copy() for book in books]
        for r in total.collect():  # a row for each entry that is used
            books[r["part"]][r["entry"]] = [int(r[c]) // int(r["n"]) for c in sums]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for entry in book for x in entry).encode()).hexdigest()


def compressed(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """`key`, code, error, label_error and codebooks_sha256 of every row that takes part; entries up to 256, two hex digits each."""
    if not 1 <= entries <= 256:
        raise ValueError("entries are from 1 to 256")
    spark = df.sparkSession
    small_batches(spark)
    found = whole_components(df, vector, scale, F.col(key).alias("id"), F.col(label).alias("label")).where(F.size("vec") % parts == 0)
    found = written(found, "vectors")
    length = found.where("id is not null").select("id", F.size("vec").alias("size")).groupBy().agg(F.min(F.struct("id", "size"))["size"].alias("size")).collect()[0]["size"]
    length = length if length is not None else found.agg(F.min(F.size("vec")).alias("size")).collect()[0]["size"]
    rows = found.where(F.size("vec") == F.lit(length))
    first = rows.where("id is not null").orderBy("id", "vec").limit(entries).select("vec").collect()
    if not first:  # no ids at all: by the order of vectors
        first = rows.orderBy("vec").limit(entries).select("vec").collect()
    if not first:
        return spark.createDataFrame([], f"`{key}` {dict(df.dtypes)[key]}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books = fit(rows, np.array([r["vec"] for r in first], np.int64), parts, rounds)
    kinds = dict(found.dtypes)
    coded = rows.select("id", "label", "vec").mapInArrow(released(_codes(spark.sparkContext.broadcast(books))), f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")
    coded = written(coded, "codes")
    limited = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_TOP).cast("decimal(38,0)")).cast("bigint")
    totals = written(coded.groupBy(F.col("label").alias("of")).agg(limited.alias("label_error")), "label-errors")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_LABELS else totals
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
