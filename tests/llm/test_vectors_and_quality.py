"""Codes of vectors, hard negatives and the quality classifier against plain versions of themselves."""

import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("quadweave.llm.queries")

SCHEMA = "vec_id bigint, embedding array<double>, label int, code string, cell string, score double"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "code", "cell", 1.0) for i, v, label in rows], SCHEMA).repartition(3)


def _random_rows(n, size, seed, labels=4, spread=1.0):
    r = random.Random(seed)
    return [(i, [round(r.gauss(0, spread), 1) for _ in range(size)], r.randrange(labels)) for i in range(n)]


ODD_ROWS = [(900, None, 1), (901, [1.0, None, 0.0, 0.0], 1), (902, [1.0, float("nan"), 0.0, 0.0], 1), (903, [1.0, float("inf"), 0.0, 0.0], 1), (904, [], 1)]


# 11


def _plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for i, v, _ in kept if i is not None][:entries] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(p, cut(v, p))[1], []).append(cut(v, p))
            for n, members in groups.items():
                books[p][n] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for i, v, label in kept:
        found = [near(p, cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), min(2**63 - 1, sum(g for g, _ in found)), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(2**63 - 1, sum(o[2] for o in out if o[3] == label)), digest) for i, c, e, label in out), key=repr)


@pytest.mark.parametrize(("n", "size", "entries", "spread"), [(120, 8, 16, 1.0), (90, 4, 40, 0.1), (10, 8, 256, 1.0), (60, 4, 8, 1e12)])
def test_codes_are_those_of_a_plain_version(spark, n, size, entries, spread):
    from quadweave.llm import vector_codes

    rows = _random_rows(n, size, n, spread=spread)
    rows += [rows[0], (None, rows[1][1], None), (n, rows[2][1], None), *([(n + 1, rows[3][1], 2)] * 30), *ODD_ROWS]
    got = vector_codes.compressed(_vectors(spark, rows), entries=entries)
    want = _plain_codes(rows, 4, entries, 4, 1024)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_codes_of_nothing_and_of_odd_lengths(spark):
    from quadweave.llm import vector_codes

    assert vector_codes.compressed(_vectors(spark, ODD_ROWS)).count() == 0
    assert vector_codes.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (6, [1.0] * 8, 1), (4, [1.0] * 6, 1), (7, [2.0, 2.0, 3.0, 4.0], 1)]
    assert sorted(r["vec_id"] for r in vector_codes.compressed(_vectors(spark, rows)).collect()) == [5, 7]
    nameless = [(None, [1.0, 2.0, 3.0, 4.0], 1)] * 2
    assert [r["error"] for r in vector_codes.compressed(_vectors(spark, nameless)).collect()] == [0, 0]


def test_codes_do_not_depend_on_partitions(spark):
    from quadweave.llm import vector_codes

    rows = _vectors(spark, _random_rows(200, 8, 5))
    found = [sorted(map(tuple, vector_codes.compressed(rows.repartition(n)).collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_gnat_finds_the_nearest_and_skips_subtrees():
    from quadweave.llm.vector_codes import Gnat, squared

    r = np.random.default_rng(3)
    for size, spread in ((2, 50), (16, 1000), (3, 2), (4, 2**45)):
        entries = r.integers(-spread, spread, (256, size))
        entries[100:110] = entries[5]  # ties
        queries = np.concatenate([r.integers(-spread, spread, (300, size)), entries[:50]])
        tree = Gnat(entries)
        place, gap = tree.nearest(queries)
        all_gaps = squared(queries, entries)
        assert (place == all_gaps.argmin(1)).all() and (gap == all_gaps.min(1)).all()
        if size == 2:
            assert tree.computed < 0.5 * all_gaps.size
    same = Gnat(np.zeros((40, 2), np.int64))
    assert same.nearest(np.array([[1, 1]]))[0][0] == 0
    # Queries that lie exactly between two entries, far from the origin.
    line = np.array([[2 * i + 10**6, 0] for i in range(64)])
    assert (Gnat(line).nearest(line[:-1] + [1, 0])[0] == np.arange(63)).all()


# 12


def _plain_negatives(rows, every, positives=5, negatives=3):
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(256 * x) for x in v])
            best[i] = min(best.get(i, row), row)
    out = []
    for a, (label, q) in best.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, own) for i, (own, v) in best.items() if i != a and len(v) == len(q)]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [(s, i) for s, i, own in scored if own != label and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(a, positive, n, i, -p, -s) for n, (s, i) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize(("size", "spread", "small"), [(3, 1.0, False), (8, 0.5, True), (2, 0.01, False), (4, 1e6, True)])
def test_negatives_are_those_of_a_plain_version(spark, monkeypatch, size, spread, small):
    from quadweave.llm import hard_negatives

    if small:  # many blocks, groups and shuffled pairs
        for name, value in (("BLOCK", 16), ("ANCHORS", 8), ("BROADCAST_PAIRS", 0), ("BROADCAST_CELLS", 0)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = _random_rows(150, size, size, spread=spread)
    rows += [rows[3], (7, rows[9][1], 0), (None, rows[0][1], 1), (400, rows[0][1], None), *((500 + i, rows[4][1], 3) for i in range(40)), (800, [1.0] * (size + 1), 1), (801, [1.0] * (size + 1), 1), (802, [0.8] * (size + 1), 2), *ODD_ROWS]
    got = hard_negatives.mine(_vectors(spark, rows), "id % 5 = 0")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _plain_negatives(rows, 5)
    assert want and sorted(map(tuple, got.collect())) == want


def test_negatives_of_nothing(spark):
    from quadweave.llm import hard_negatives

    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), "id % 5 = 0").count() == 0
    assert hard_negatives.mine(_vectors(spark, [(0, [1.0], 1), (1, [1.0], 1)]), "id % 5 = 0").count() == 0  # one label only
    assert hard_negatives.mine(_vectors(spark, [(0, [1.0], 1), (1, [1.0], 2)]), "id % 5 = 0").count() == 0  # no positive


def test_descent_skips_what_is_outside_the_windows():
    from quadweave.llm.hard_negatives import Index

    r = np.random.default_rng(1)
    centres = r.normal(0, 400, (40, 6))
    points = np.rint(np.concatenate([c + r.normal(0, 5, (50, 6)) for c in centres])).astype(np.int64)
    ids, labels = np.arange(len(points)), r.integers(0, 5, len(points))
    index = Index(points, ids, labels)
    lower, upper = index.bounds(points[:50].astype(np.float64))
    for i in range(50):
        scores = points @ points[i]
        for node, members in enumerate(index.members):
            assert lower[i, node] <= scores[members].min() and scores[members].max() <= upper[i, node]
        top = int(np.sort(scores)[-10])
        windows = [(top // 2, top * 95 // 100), (float("-inf"), float("inf"))]
        found = index.search(points[i], i, lower[i], upper[i], 3, windows, int(labels[i]))
        for (low, high), (best, at) in zip(windows, found, strict=True):
            fit = np.flatnonzero((scores >= low) & (scores <= high) & (labels != labels[i]) & (ids != i))
            order = fit[np.lexsort((fit, -scores[fit]))][:3]
            assert at.tolist() == order.tolist() and best.tolist() == scores[order].tolist()
    assert index.compared < 0.5 * 50 * len(points)


# 13


def test_counts_are_those_of_a_plain_version():
    import pyarrow as pa

    from quadweave.llm import quality

    texts = ["The cat, the CAT! 12 a b\nthe cat sat", None, "", " \n\t", "x" * 700_000, "ab cd " * 150_000, "| a | b", "ü é Ñ 漢"]
    got = quality.counts(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        threes = [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        at = dict(zip(quality.COUNTS, row.tolist(), strict=True))
        assert at["words"] == len(words) and at["distinct"] == len(set(words)) and at["shingles"] == len(threes)
        assert at["repeated"] == len(threes) - len(set(threes)) and at["most_frequent"] == max(map(words.count, set(words)), default=0)
        assert at["word_bytes"] == sum(len(w.encode()) for w in words) and at["lines"] == (text or "").count("\n")
        assert at["capitals"] == sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text or "") and at["digits"] == sum(c in "0123456789" for c in text or "")
    assert dict(zip(quality.COUNTS, got[0].tolist(), strict=True))["symbols"] == 1


def test_moments_and_densities_are_those_of_numpy(spark):
    from quadweave.llm import quality

    r = np.random.default_rng(2)
    counted = np.abs(r.normal(200, 60, (400, len(quality.COUNTS)))).astype(np.int64)
    counted[:, :2] += 1000  # wholes
    counted[:, 2] += 3000
    labels = r.integers(0, 2, 400)
    counted[labels == 1, 4] //= 3
    rows = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(counted)], "key bigint, " + ", ".join(f"{c} bigint" for c in quality.COUNTS)).repartition(5)
    known = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)] + [(0, int(labels[0])), (3, None), (4, 7), (None, 1)], "key bigint, label int")
    model = quality.fit(rows, known)
    x = quality.statistics(counted, model.given) / quality.STEPS
    logs = []
    pooled = sum(np.cov(x[labels == c].T, bias=True) * (labels == c).sum() for c in (0, 1)) / 400
    for c in (0, 1):
        own = x[labels == c]
        weight = 2 * x.shape[1] / (len(own) + 2 * x.shape[1])
        spread = (1 - weight) * np.cov(own.T, bias=True) + weight * pooled
        spread = (1 - quality.RIDGE) * spread + quality.RIDGE * np.diag(np.diag(pooled))
        gap = x - own.mean(0)
        logs.append(np.log((len(own) + 1) / 402) - 0.5 * np.linalg.slogdet(spread)[1] - 0.5 * np.einsum("ni,ij,nj->n", gap, np.linalg.inv(spread), gap))
    assert np.allclose(model.scores(counted), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), atol=1e-6)


def test_held_out_documents_are_told_apart(spark):
    from quadweave.llm import quality

    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = quality.scored(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    known = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (known["predicted"] == known["quality"]).mean() > 0.97
    assert known[known["quality"] == 0]["score"].mean() + 0.5 < known[known["quality"] == 1]["score"].mean()
    # Labels of held-out rows, lang, source and partitions have no say.
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.scored(docs.select("doc_id", "text").repartition(7), turned)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(again) == rows(got)


def test_quality_of_odd_rows(spark):
    from quadweave.llm import quality

    docs = spark.createDataFrame([(1, None, "x", 1), (1, None, "x", 1), (2, "", "x", 1), (None, "a b c", "x", 1), (3, "word " * 2000, "x", 0)], "doc_id bigint, text string, key string, score int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 1)], "doc_id bigint, quality int")
    for known in (labels, labels.where("quality = 1"), labels.limit(0)):
        got = quality.scored(docs, known).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and all(r["predicted"] == (r["score"] >= 0.3) for r in got)
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quality.scored(docs.limit(0), labels).count() == 0
