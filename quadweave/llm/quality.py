"""A quality classifier: regularised quadratic discriminant analysis of document statistics.

Every text is described by what is counted over the whole of it: its words and their lengths, what of it are capitals, digits, punctuation,
other symbols and lines, and how much of it repeats.  Counts become shares, drawn towards the mean share of the labelled texts as if
`PRIOR` more words were like these, so that a short text is not judged by chance, and then logarithms of odds or rates, which are nearer
to normal.  Each class is a normal distribution with a covariance of its own, shrunk towards that of both classes the more, the fewer
rows it has, and towards its diagonal a little.  A score is the posterior of label 1: the difference of the log densities,
whose Mahalanobis distances come from Cholesky factors computed once, and of the logarithms of the classes' shares.

Statistics are rounded to whole 256ths, and means to millionths, so that the sums which the fit needs (one row a task and class) are whole
numbers, exact and the same however rows are dealt to tasks.  All labelled rows are used.  Texts are read once; the fit and the scores use
a table of counts.

Defined results: null and empty texts have the statistics of no words and a score like all others.  A label is a
(key, label) pair of value 0 or 1; repeated ones count once, contradicting ones once in each class; each row of a repeated document
counts.  Rows without key are scored, are not held out and teach nothing.  Without rows of both labels all scores are (ones + 1) / (rows + 2).
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.kernels import SLICE_BYTES, shingles, text_buffer, word_slices
from quadweave.llm.language import held_out
from quadweave.llm.scratch import released, small_batches, written

#: Share of the pooled diagonal in every covariance.
RIDGE = 0.02
STEPS = 256
#: Bounds of a statistic, so that sums of products of 10^10 rows are exact in a long.
MOST = 64 * STEPS
#: Words of mean shares that are added to every text.
PRIOR = 10
COUNTS = ("words", "shingles", "letters", "word_bytes", "capitals", "digits", "punctuation", "symbols", "lines", "distinct", "most_frequent", "one_byte", "short", "repeated")
#: What is taken of what, as odds or else as a rate.
SHARES = (
    ("word_bytes", "words", False), ("capitals", "letters", True), ("digits", "words", False), ("punctuation", "words", False), ("symbols", "words", False), ("lines", "words", False),
    ("distinct", "words", True), ("most_frequent", "words", True), ("one_byte", "words", True), ("short", "words", True), ("repeated", "shingles", True),
)
STATISTICS = ("words", *(part for part, _, _ in SHARES))
#: Bytes as: space, line feed, capital, small letter (all bytes beyond ASCII too), digit, punctuation of prose, other symbol.
_KINDS = 7
_KIND = np.full(256, 6, np.uint8)
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 0, 1
_KIND[ord("A") : ord("Z") + 1], _KIND[ord("a") : ord("z") + 1], _KIND[128:] = 2, 3, 3
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5


def _kinds(column: pa.Array) -> np.ndarray:
    """How many bytes of each kind every text has."""
    data, offsets = text_buffer(column)
    counts = np.zeros((len(offsets) - 1, _KINDS), np.int64)
    at = int(offsets[0])
    while at < offsets[-1]:
        stop = min(at + SLICE_BYTES, int(offsets[-1]))
        first, last = (int(np.searchsorted(offsets, x, "right")) - 1 for x in (at, stop - 1))
        inside = np.diff(np.clip(offsets[first : last + 2], at, stop))
        row = np.repeat(np.arange(last - first + 1), inside)
        counts[first : last + 1] += np.bincount(row * _KINDS + _KIND[data[at:stop]], minlength=(last - first + 1) * _KINDS).reshape(-1, _KINDS)
        at = stop
    return counts


def _runs(row: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values every row has, and how often its most frequent one stands there; row is ascending."""
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    starts = np.flatnonzero(new)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row[starts], np.diff(np.append(starts, len(row))))
    return np.bincount(row[starts], minlength=rows), most


def counts(column: pa.Array) -> np.ndarray:
    """The `COUNTS` of every text."""
    kinds = _kinds(column)
    n = len(column)
    words, distinct, most, one, short, shingled, repeated = (np.zeros(n, np.int64) for _ in range(7))
    for i, j, hashes, bounds, places in word_slices(column):
        sizes = np.diff(bounds)
        row = np.repeat(np.arange(j - i), sizes)
        words[i:j] = sizes
        distinct[i:j], most[i:j] = _runs(row, hashes, j - i)
        gaps, same = np.diff(places), row[1:] == row[:-1]
        one[i:j] = np.bincount(row[1:][same & (gaps <= 2)], minlength=j - i)
        short[i:j] = np.bincount(row[1:][same & (gaps <= 4)], minlength=j - i)
        threes = [shingles(hashes[bounds[r] : bounds[r + 1]], 3) for r in range(j - i)]
        shingled[i:j] = [len(t) for t in threes]
        found, _ = _runs(np.repeat(np.arange(j - i), [len(t) for t in threes]), np.concatenate(threes), j - i)
        repeated[i:j] = shingled[i:j] - found
    _, lines, capitals, small, digits, punctuation, symbols = kinds.T
    return np.stack([words, shingled, capitals + small, kinds[:, 2:].sum(1), capitals, digits, punctuation, symbols, lines, distinct, most, one, short, repeated], 1)


def statistics(counted: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The transformed `STATISTICS` of counts, in whole `STEPS`ths; `means`: the mean share of each of `SHARES`."""
    of = {name: counted[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    told = [np.log1p(of["words"])]
    for (part, whole, odds), mean in zip(SHARES, means, strict=True):
        share = (of[part] + PRIOR * mean) / (of[whole] + PRIOR)
        told.append(np.log(share / (1 - share)) if odds else np.log(share))
    return np.clip(np.rint(np.stack(told, 1) * STEPS), -MOST, MOST).astype(np.int64)


def _counted(batches):
    for batch in batches:
        found = counts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c) for c in np.ascontiguousarray(found.T))], ["key", *COUNTS])


def _matrix(batch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in COUNTS], 1)


def _moments(means: np.ndarray):
    def run(batches):
        """Of each class: rows, sums and sums of products, in one row."""
        d = len(STATISTICS)
        total = np.zeros((2, 1 + d + d * d), np.int64)
        for batch in batches:
            label, x = batch.column("label").to_numpy(), statistics(_matrix(batch), means)
            for c in (0, 1):
                own = x[label == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        kept = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), *(pa.array(c) for c in total[kept].T)], ["label", *(f"m{i}" for i in range(total.shape[1]))])

    return run


class Discriminant:
    """Two normal distributions, from (rows, sums, sums of products) of both classes; `means`: see `statistics`."""

    def __init__(self, moments: dict[int, list[int]], means: np.ndarray):
        d = len(STATISTICS)
        self.given = means
        rows = [int(moments.get(c, [0])[0]) for c in (0, 1)]
        self.share = (rows[1] + 1) / (sum(rows) + 2)
        self.fitted = min(rows) > 0
        if not self.fitted:
            return
        scatter, self.means = [], []
        for c in (0, 1):
            sums = np.array(moments[c][1 : d + 1], object)
            products = np.array(moments[c][d + 1 :], object).reshape(d, d)
            # n * sum(x x') - sum(x) sum(x)' is a whole number of any size: nothing cancels in floating point.
            scatter.append((products * rows[c] - np.outer(sums, sums)).astype(np.float64) / rows[c] / STEPS**2)
            self.means.append((sums / rows[c]).astype(np.float64) / STEPS)
        pooled = (scatter[0] + scatter[1]) / sum(rows)
        diagonal = np.diag(np.maximum(np.diag(pooled), 1e-4))
        self.factors, self.constants = [], []
        for c in (0, 1):
            weight = 2 * d / (rows[c] + 2 * d)
            spread = (1 - weight) * scatter[c] / rows[c] + weight * pooled
            factor = np.linalg.cholesky((1 - RIDGE) * spread + RIDGE * diagonal)
            self.factors.append(np.linalg.inv(factor))
            self.constants.append(np.log((rows[c] + 1) / (sum(rows) + 2)) - np.log(np.diag(factor)).sum())

    def scores(self, counted: np.ndarray) -> np.ndarray:
        """Posterior of label 1 of texts with such counts."""
        if not self.fitted:
            return np.full(len(counted), self.share)
        x = statistics(counted, self.given) / STEPS
        logs = [k - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, k in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def counted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the counts of every row."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(released(_counted), f"key {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """rows: key and counts; labels: (key, label), of which 0 and 1 count."""
    known = labels.where("key is not null and label in (0, 1)").select("key", F.col("label").cast("int").alias("label")).distinct()
    known = written(rows.join(known, "key").select("label", *COUNTS), "labelled")
    shares = [F.avg(F.floor(F.col(part) * 1_000_000 / F.col(whole))) for part, whole, _ in SHARES]
    found = known.where("words > 0 and letters > 0 and shingles > 0").agg(*(s.alias(f"a{i}") for i, s in enumerate(shares))).collect()[0]
    # No share is 0 or 1, so that logarithms are finite.
    means = np.array([min(max((found[i] or 0) / 1e6, 0.001), 0.999 if odds else 1e6) for i, (_, _, odds) in enumerate(SHARES)])
    names = [f"m{i}" for i in range(1 + len(STATISTICS) + len(STATISTICS) ** 2)]
    parts = known.mapInArrow(_moments(means), "label int, " + ", ".join(f"{n} bigint" for n in names))
    totals = parts.groupBy("label").agg(*(F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names)).collect()  # a row a class
    return Discriminant({r["label"]: [int(r[n]) for n in names] for r in totals}, means)


def scored(df: DataFrame, labels: DataFrame, least: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """`key`, held_out, score and predicted of every row of df; labels of held-out keys teach nothing."""
    rows = written(counted(df, key, text), "counts")
    model = fit(rows.where(~held_out(F.col("key"))), labels.select(F.col(key).alias("key"), F.col(label).alias("label")))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = shared.value.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores)], ["key", "score"])

    found = rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, score double")
    return found.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))
