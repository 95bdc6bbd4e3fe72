"""Exact mining of hard negatives, by cover trees over norm-augmented candidates.

A candidate x gets one more component, sqrt(M * M - |x|^2) with M the largest norm of its block, an anchor q gets a zero.  Then
all candidates have norm M, and an inner product is a matter of distance alone: q.x = (|q|^2 + M^2 - d^2) / 2.  A node of a
cover tree with centre c and covering radius r holds distances from d(q, c) - r to d(q, c) + r, hence inner products between

    (|q|^2 + M^2 - (d(q, c) + r)^2) / 2   and   (|q|^2 + M^2 - max(0, d(q, c) - r)^2) / 2.

Two searches run, both best-first by the upper bound.  Positives: the best of the anchor's own label, in blocks of that label.
Negatives: each positive has a window of scores, from `low` to `high` per cent of its own; nodes outside all windows of the
anchor, or below the worst of what its windows hold already, are skipped; leaves are verified by integer scores.

On the cluster, candidates go to the nearest of 16 centres of a bounded sample, large cells are dealt into blocks by a
hash, and a block meets only the groups of anchors that want it, each pair in a task of its own.  Cells are bounded like
nodes of a tree, from plain distances: q.x <= q.c + |q| r, and no less than q.c - |q| r.

Defined results: rows whose id or label is null, or whose vector is null, empty, or holds a null or non-finite component,
take no part.  Of rows that share an id the one with the smallest label takes part, then the smallest vector, so a repeated
row counts once.  Vectors of different lengths never meet.  Ties go to the smaller id.  Scores beyond a long are held at its limits.
A positive with a negative score has no window and gets no row.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.covertree import CoverTree, exact_scores, far_pivots, nearest, quantised
from quadweave.llm.scratch import written

#: Candidates, and anchors, that a task holds at once.
BLOCK = 8_192
ANCHORS = 4_096
LEAF = 64
LEAF_SHARE = 8
#: Anchors whose bounds are computed by one product.
AT_ONCE = 256
#: Pairs of blocks and groups, and cells, up to which they are broadcast.
BROADCAST_PAIRS = 1_000_000
BROADCAST_CELLS = 10_000


class Index:
    """A cover tree over augmented candidates as flat arrays."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.points, self.ids, self.labels = points, ids, labels
        floats = points.astype(np.float64)
        norms = (floats**2).sum(1)
        self.most = float(norms.max(initial=0.0))  # M^2
        augmented = np.concatenate([floats, np.sqrt(np.maximum(0.0, self.most - norms))[:, None]], 1)
        nodes = [CoverTree(augmented, leaf=LEAF, share=LEAF_SHARE)]
        self.children: list[list[int]] = []
        at = 0
        while at < len(nodes):
            self.children.append(list(range(len(nodes), len(nodes) + len(nodes[at].children))))
            nodes += nodes[at].children
            at += 1
        self.members = [n.members for n in nodes]
        self.centres = np.stack([n.centre for n in nodes])
        self.radii = np.array([n.radius for n in nodes])
        self.compared = 0  # candidates whose scores were computed

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the inner products of every anchor with every node; rounding never narrows them."""
        own = (anchors**2).sum(1)[:, None]
        squares = own + (self.centres**2).sum(1)[None] - 2 * anchors @ self.centres[:, :-1].T
        slack = 1e-9 * (own + self.most) + 1e-6
        gaps, spare = np.sqrt(np.maximum(0.0, squares)), np.sqrt(slack)
        far, near = gaps + self.radii + spare, np.maximum(0.0, gaps - self.radii - spare)
        return (own + self.most - far**2) / 2 - slack, (own + self.most - near**2) / 2 + slack

    def search(self, anchor: np.ndarray, anchor_id: int, lower: np.ndarray, upper: np.ndarray, k: int, windows: list[tuple[float, float]], label: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of the k best of every window, best-first from the root; `label`: whose rows are left out."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        floors = [low for low, _ in windows]
        heap = [(-upper[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < min(floors):
                break
            wanted = [w for w, (_, high) in enumerate(windows) if -bound >= floors[w] and lower[node] <= high]
            if not wanted:
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-upper[child], child))
                continue
            rows = self.members[node]
            rows = rows[self.ids[rows] != anchor_id]
            rows = rows if label is None else rows[self.labels[rows] != label]
            if not len(rows):
                continue
            self.compared += len(rows)
            scores = exact_scores(anchor[None], self.points[rows])[0]
            for w in wanted:
                inside = np.flatnonzero((scores >= floors[w]) & (scores <= windows[w][1]))
                if not len(inside):
                    continue
                found, ids = np.concatenate([best[w][0], scores[inside]]), np.concatenate([best[w][1], self.ids[rows[inside]]])
                order = np.lexsort((ids, -found))[:k]
                best[w] = found[order], ids[order]
                if len(order) == k:
                    floors[w] = max(floors[w], int(found[order[-1]]))
        return best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _mined(k: int, windows: bool):
    """Per (block, group of anchors): the k best of every anchor, or of each of its windows."""

    def run(table):
        is_anchor = table["is_anchor"].to_numpy().astype(bool)
        data, anchors = table.filter(pa.array(~is_anchor)), table.filter(pa.array(is_anchor))
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        if len(data) and len(anchors):
            index = Index(_matrix(data["vec"]), data["id"].to_numpy(), data["label"].to_numpy())
            asked, ids, labels = _matrix(anchors["vec"]), anchors["id"].to_numpy(), anchors["label"].to_numpy()
            wanted = anchors["windows"].to_pylist() if windows else None
            for at in range(0, len(asked), AT_ONCE):
                lower, upper = index.bounds(asked[at : at + AT_ONCE].astype(np.float64))
                for i in range(at, min(at + AT_ONCE, len(asked))):
                    own = [(w["low"], w["high"]) for w in wanted[i]] if windows else [(float("-inf"), float("inf"))]
                    for w, (scores, found) in enumerate(index.search(asked[i], ids[i], lower[i - at], upper[i - at], k, own, labels[i] if windows else None)):
                        place = np.full(len(found), wanted[i][w]["positive"] if windows else 0)
                        for column, values in zip(out, (np.full(len(found), ids[i]), place, found, scores), strict=True):
                            column.append(values)
        return pa.table(dict(zip(("anchor_id", "positive_id", "id", "score"), map(np.concatenate, out), strict=True)))

    return run


_MINED = "anchor_id bigint, positive_id bigint, id bigint, score bigint"


def _searched(data: DataFrame, anchors: DataFrame, cell: list[str], groups: int, k: int, windows: bool, name: str) -> DataFrame:
    """data (*cell, block, id, label, vec) against anchors (*cell, id, label, vec, windows), of which each asks for a whole cell.

    A block of data goes only to the groups of anchors that ask for its cell."""
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group")
    asking = anchors.select(*cell, group).distinct()
    blocks = data.select(*cell, "block").distinct()
    meet = written(asking.join(blocks, cell), f"{name}-meet")
    meet = F.broadcast(meet) if meet.count() <= BROADCAST_PAIRS else meet
    none = F.lit(None).cast("array<struct<positive:bigint,low:bigint,high:bigint>>").alias("windows")
    columns = [*cell, "block", "group", "id", *(c for c in ["label"] if c not in cell), "vec", "windows", "is_anchor"]
    sent = data.join(meet, [*cell, "block"]).withColumns({"windows": none, "is_anchor": F.lit(False)}).select(columns)
    spread = anchors.withColumn("group", group).join(meet, [*cell, "group"]).withColumn("is_anchor", F.lit(True)).select(columns)
    return written(sent.unionByName(spread).groupBy(*cell, "block", "group").applyInArrow(_mined(k, windows), _MINED), name)


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cells(shared):
    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.list_value_length(batch.column("vec")).to_numpy()
            cell, gap = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                points = np.stack(batch.column("vec").take(pa.array(rows)).to_numpy(zero_copy_only=False)).astype(np.float64)
                cell[rows], gap[rows] = nearest(points, shared.value.get(int(size), np.zeros((1, int(size)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(cell), pa.array(gap)], [*batch.schema.names, "size", "cell", "gap"])

    return run


def _wanted_cells(shared, cells):
    """Cells that hold a score of some window of the anchor, by the cell's centre and radius."""

    def run(batches):
        for batch in batches:
            rows, to = [], []
            for i, (vec, windows) in enumerate(zip(batch.column("vec").to_pylist(), batch.column("windows").to_pylist(), strict=True)):
                q = np.array(vec, np.float64)
                norm = float(np.sqrt(q @ q))
                centres = shared.value.get(len(vec), np.zeros((1, len(vec))))
                for place, radius in cells.value.get(len(vec), ()):
                    dot = float(q @ centres[place])
                    spread = norm * radius * (1 + 1e-9) + 1e-9 * abs(dot) + 1e-6 + 1e-9 * norm * float(np.abs(centres[place]).sum())
                    if any(dot + spread >= w["low"] and dot - spread <= w["high"] for w in windows):
                        rows.append(i)
                        to.append(place)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to, pa.int32())], [*batch.schema.names, "cell"])

    return run


def mine(df: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where `anchors` (of column `id`) holds.

    A negative's score is from `low` to `high` per cent of the positive's.  Lengths of vectors are few: one cell list for each."""
    if not 0 <= low <= high:
        raise ValueError("low and high are per cent, low at most high")
    spark = df.sparkSession
    known = df.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).cast("bigint").alias("label"))
    rows = quantised(known, "key", "vector", "label")
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.label", "row.vec")
    rows = written(rows, "candidates")
    pivots = spark.sparkContext.broadcast(far_pivots(rows))
    placed = written(rows.mapInArrow(_cells(pivots), "id bigint, label bigint, vec array<bigint>, size int, cell int, gap double"), "placed")

    def dealt(*cell: str) -> DataFrame:
        counts = written(placed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cells")
        counts = F.broadcast(counts) if counts.count() <= BROADCAST_CELLS else counts
        return placed.join(counts, list(cell)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    asked = written(placed.where(anchors).select("size", "id", "label", "vec"), "anchors")
    groups = max(1, -(-asked.count() // ANCHORS))
    none = F.lit(None).cast("array<struct<positive:bigint,low:bigint,high:bigint>>")
    found = _searched(dealt("size", "label"), asked.withColumn("windows", none), ["size", "label"], groups, positives, False, "positives")
    first = written(_best(found, positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "first")

    # Whole numbers s with low * p <= 100 * s <= high * p; decimals hold products of longs.
    p = F.col("positive_score").cast("decimal(20,0)")
    least, most = F.ceil(p * low / 100).cast("bigint"), F.floor(p * high / 100).cast("bigint")
    windows = first.where("positive_score >= 0").select("anchor_id", F.struct(F.col("positive_id").alias("positive"), least.alias("low"), most.alias("high")).alias("w")).where("w.low <= w.high")
    windows = windows.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("w").alias("windows"))  # `positives` at most
    radii = placed.groupBy("size", "cell").agg(F.max("gap").alias("radius")).collect()  # one for each pivot of each length
    cells: dict[int, list] = {}
    for r in radii:
        cells.setdefault(r["size"], []).append((r["cell"], r["radius"] * (1 + 1e-9) + 1e-6))
    wanting = asked.join(windows, "id").select("size", "id", "label", "vec", "windows")
    kind = "size int, id bigint, label bigint, vec array<bigint>, windows array<struct<positive:bigint,low:bigint,high:bigint>>, cell int"
    wanting = written(wanting.mapInArrow(_wanted_cells(pivots, spark.sparkContext.broadcast(cells)), kind), "wanting")
    found = _searched(dealt("size", "cell"), wanting, ["size", "cell"], groups, negatives, True, "negatives")
    best = _best(found, negatives).join(first, ["anchor_id", "positive_id"])
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
