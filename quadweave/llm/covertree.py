"""Exact top-k by inner product: cover trees over queries and data, searched together.

Coarse level, on the cluster: a bounded sample gives `PIVOTS` centres; every vector goes to the node of its
nearest centre, and large nodes are dealt into blocks by a hash, so that equal vectors, however many, spread.
A node of queries and a block of data are described by centre and covering radius (the largest distance of a
member from the centre), which bound every inner product between them from above:

    q.d <= cq.cd + |cq| rd + |cd| rq + rq rd.

Every query first searches the blocks of the closest node, which gives each query group its worst k-th score.
Pairs of nodes whose bound is below it are pruned; the rest are searched.  Inside a task both sides are
indexed by a cover tree (levels of centres, radii halving), and pairs of tree nodes are pruned alike.

Scores are integers and exact; ties go to the smaller id.  Queries meet data block by block, never row by
row; what a task holds is one block of data and one block of queries.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, nor do rows
without id.  Vectors of another length than most take no part in a search against the others: each length
is searched by itself.  Scores beyond a long are held at its limits.  Repeated rows are candidates each; a query does not find rows of its own id.  With
fewer than k candidates all are returned.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.scratch import written

PIVOTS = 16
#: Rows from which the pivots are drawn.
SAMPLE = 2_000
#: Rows of data, and of queries, that a task holds at once.
DATA_BLOCK = 8_192
QUERY_GROUP = 16_384
#: Pairs of blocks and query groups up to which they are broadcast.
BROADCAST_PAIRS = 1_000_000
#: Queries that are indexed by one tree.
QUERY_BLOCK = 2_048
LEAF = 256
LEAF_SHARE = 32
#: Queries of a leaf, and of a cover at least; their leaves are small, since each is compared by its worst member.
QUERY_LEAF = 16
QUERY_SHARE = 2


class CoverTree:
    """Nested covers: the members of a child are at most half the node's radius away from the child's centre.

    A node stays whole where halves would be too many to be worth it: more than one for every `share` members."""

    def __init__(self, points: np.ndarray, members: np.ndarray | None = None, centre: np.ndarray | None = None, leaf: int = LEAF, share: int = LEAF_SHARE):
        self.members = np.arange(len(points)) if members is None else members
        own = points[self.members]
        self.centre = own.mean(0)
        gaps = np.sqrt(((own - self.centre) ** 2).sum(1))
        if centre is not None and (around := np.sqrt(((own - centre) ** 2).sum(1))).max() < gaps.max():
            self.centre, gaps = centre, around
        # Rounding may not shrink a bound.
        self.radius = float(gaps.max()) * (1 + 1e-9) + 1e-6
        self.norm = float(np.sqrt((self.centre**2).sum())) * (1 + 1e-9)
        self.children: list[CoverTree] = []
        if len(own) > leaf and self.radius > 1e-3:
            groups = self._cover(own, self.radius / 2, share)
            if len(groups) > 1:
                self.children = [CoverTree(points, self.members[g], own[c], leaf, share) for c, g in groups]

    @staticmethod
    def _cover(own: np.ndarray, radius: float, share: int) -> list[tuple[int, np.ndarray]]:
        """(centre, members): farthest-first centres until all is covered, members go to the nearest; nothing if that takes too many."""
        near = np.full(len(own), np.inf)
        to = np.zeros(len(own), np.int64)
        at, centres = 0, []
        while near[at] > radius * radius:
            if len(centres) * share > len(own):
                return []
            gap = ((own - own[at]) ** 2).sum(1)
            to[gap < near] = len(centres)
            near = np.minimum(near, gap)
            centres.append(at)
            at = int(near.argmax())
        return [(c, g) for c, g in ((c, np.flatnonzero(to == n)) for n, c in enumerate(centres)) if len(g)]

    def bound(self, other: CoverTree) -> float:
        dot = float(self.centre @ other.centre)
        return dot + abs(dot) * 1e-9 + self.norm * other.radius + other.norm * self.radius + self.radius * other.radius


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point while every sum stays below 2^53, else by integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = a.astype(object).dot(b.T.astype(object))
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors
        self.scores = [np.zeros(0, np.int64) for _ in floors]
        self.ids = [np.zeros(0, np.int64) for _ in floors]

    def worst(self, rows: np.ndarray) -> float:
        """The least k-th score of some queries."""
        return float(min(self.floors[rows]))

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        kept = scores >= self.floors[row]
        if not kept.any():
            return
        scores, ids = np.concatenate([self.scores[row], scores[kept]]), np.concatenate([self.ids[row], ids[kept]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[row], self.ids[row] = scores[order], ids[order]
        if len(order) == self.k:
            self.floors[row] = max(self.floors[row], scores[order[-1]])


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, tree: CoverTree, data: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Adds to `best` what a block of data has for a block of queries."""
    points = queries.astype(np.float64)
    norms = np.sqrt((points**2).sum(1)) * (1 + 1e-9)
    open_pairs = [(CoverTree(points, leaf=QUERY_LEAF, share=QUERY_SHARE), tree)]
    while open_pairs:
        q, d = open_pairs.pop()
        if q.bound(d) < best.worst(q.members):
            continue
        if not q.children and not d.children:
            # Every query of the leaf once more by itself, with no radius of its own.
            dots = points[q.members] @ d.centre
            rows = q.members[dots + np.abs(dots) * 1e-9 + norms[q.members] * d.radius >= best.floors[q.members]]
            if not len(rows):
                continue
            scores = exact_scores(queries[rows], data[d.members])
            for i, row in enumerate(rows):
                best_of = np.flatnonzero((scores[i] >= best.floors[row]) & (ids[d.members] != query_ids[row]))
                if len(best_of):
                    best.add(row, scores[i][best_of], ids[d.members][best_of])
            continue
        split = d.children and (not q.children or d.radius >= q.radius)
        pairs = [(q, c) for c in d.children] if split else [(c, d) for c in q.children]
        open_pairs += sorted(pairs, key=lambda p: p[0].bound(p[1]))  # the best bound is taken first


def quantised(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(id, vec): floor(256 * x) of every component, with the columns `more`; rows that take no part are left out."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(sound).select(F.col(key).cast("bigint").alias("id"), F.transform(x, lambda v: F.floor(256 * v)).alias("vec"), *more)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.int64) if len(column) else np.zeros((0, 1), np.int64)


def far_pivots(rows: DataFrame, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """For every length of vectors in a bounded sample, centres that are far from each other."""
    sample = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    by_size: dict[int, list] = {}
    for vec in sample["vec"].to_pylist():
        by_size.setdefault(len(vec), []).append(vec)
    pivots = {}
    for size, vectors in by_size.items():
        points = np.array(vectors, np.float64)
        chosen = [0]  # farthest-first
        near = ((points - points[0]) ** 2).sum(1)
        while len(chosen) < min(most, len(points)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
        pivots[size] = points[chosen]
    return pivots


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A near centre of every point (the nearest but for rounding), and the distance to it; takes one number for each pair."""
    squares = (points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T
    place = squares.argmin(1)
    return place, np.sqrt(((points - centres[place]) ** 2).sum(1))


def _nodes(pivots):
    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            node, gap, group = np.zeros(len(sizes), np.int32), np.zeros(len(sizes)), sizes.astype(np.int32)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                centres = pivots.value.get(int(size))
                if centres is None:  # a length outside the sample has one node, around the origin
                    centres = np.zeros((1, int(size)))
                points = _matrix(batch.column("vec").take(pa.array(rows))).astype(np.float64)
                node[rows], gap[rows] = nearest(points, centres)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(group), pa.array(node), pa.array(gap)], ["id", "vec", "size", "node", "gap"])

    return run


def _search(k: int):
    """Per (data block, query block): the best k of every query."""

    def run(table):
        is_query = table["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        data, queries = table.filter(pa.array(~is_query)), table.filter(pa.array(is_query))
        out_q, out_i, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(data) and len(queries):
            points, ids = _matrix(data["vec"].combine_chunks()), data["id"].to_numpy()
            tree = CoverTree(points.astype(np.float64))
            asked, query_ids, floors = _matrix(queries["vec"].combine_chunks()), queries["id"].to_numpy(), queries["floor"].to_numpy().astype(np.float64)
            for at in range(0, len(asked), QUERY_BLOCK):
                part = slice(at, at + QUERY_BLOCK)
                best = Best(k, floors[part].copy())
                dual_tree(asked[part], query_ids[part], tree, points, ids, best)
                for row, q in enumerate(query_ids[part]):
                    out_q.append(np.full(len(best.ids[row]), q))
                    out_i.append(best.ids[row])
                    out_s.append(best.scores[row])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_s)})

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best for every row where `queries` (of column `id`) holds."""
    spark = df.sparkSession
    rows = written(quantised(df, key, vector), "vectors")
    pivots = far_pivots(rows)
    shared = spark.sparkContext.broadcast(pivots)
    placed = written(rows.mapInArrow(_nodes(shared), "id bigint, vec array<bigint>, size int, node int, gap double"), "placed")
    sizes = placed.groupBy("size", "node").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    # Blocks of a node: as many as its size asks for; rows are dealt by a hash of the whole row's place.
    blocks = F.ceil(F.col("n") / DATA_BLOCK).cast("int")
    nodes = written(sizes.withColumn("blocks", blocks), "nodes")  # at most PIVOTS for each length
    dealt = placed.join(F.broadcast(nodes.select("size", "node", "blocks")), ["size", "node"])
    asked = written(placed.where(queries).select("size", F.col("node").alias("qnode"), "id", "vec", "gap").distinct(), "asked")
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    data = dealt.select("size", "node", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "vec")

    def searched(wanted: DataFrame, name: str) -> DataFrame:
        """wanted: queries (size, id, vec, floor) with the node to search; all its blocks are searched.

        A block of data goes to the groups that want its node, and meets each in a task of its own."""
        spread = wanted.join(F.broadcast(nodes.select("size", "node", "blocks")), ["size", "node"]).select("size", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), "id", "vec", "floor")
        meet = written(spread.select("size", "node", "block", "group").distinct(), "meet")
        sent = data.join(F.broadcast(meet) if meet.count() <= BROADCAST_PAIRS else meet, ["size", "node", "block"])
        both = sent.withColumn("floor", F.lit(0.0)).withColumn("is_query", F.lit(False)).unionByName(spread.withColumn("is_query", F.lit(True)))
        return written(both.groupBy("size", "node", "block", "group").applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint"), name)

    low = F.lit(float("-inf"))
    own = asked.select("size", F.col("qnode").alias("node"), "id", "vec", low.alias("floor"))
    first = searched(own, "own-nodes")
    floors = _best(first, k).groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least")).select(F.col("query_id").alias("id"), F.when(F.col("found") >= k, F.col("least").cast("double")).otherwise(low).alias("floor"))
    known = written(asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", low)), "floors")
    sides = known.groupBy("size", "qnode").agg(F.max("gap").alias("qradius"), F.min("floor").alias("worst")).collect()  # at most PIVOTS for each length
    kept, of_size = [], {}
    for n in nodes.collect():
        of_size.setdefault(n["size"], []).append(n)
    for g in sides:
        centres = pivots.get(g["size"], np.zeros((1, g["size"])))
        for n in of_size[g["size"]]:
            cq, cd = centres[g["qnode"]], centres[n["node"]]
            rq, rd = g["qradius"] * (1 + 1e-9) + 1e-6, n["radius"] * (1 + 1e-9) + 1e-6
            dot = float(cq @ cd)
            bound = dot + abs(dot) * 1e-9 + (np.linalg.norm(cq) * rd + np.linalg.norm(cd) * rq) * (1 + 1e-9) + rq * rd
            if n["node"] != g["qnode"] and bound >= g["worst"]:
                kept.append((g["size"], g["qnode"], n["node"]))
    rest = first.limit(0)
    if kept:
        pairs = spark.createDataFrame(kept, "size int, qnode int, node int")
        rest = searched(known.join(F.broadcast(pairs), ["size", "qnode"]).select("size", "node", "id", "vec", "floor"), "other-nodes")
    found = _best(first.unionByName(rest), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
