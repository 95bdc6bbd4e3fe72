"""Masked pseudo-likelihood: a small bidirectional window network scores every token from both sides.

Tokens are words, and the vocabulary is every word of the corpus, with its count, in a written table that
grows with the corpus.  A word's probability has two factors,

    P(word | both sides) = P(class | both sides) * P(word | class).

The `FREQUENT` most frequent words have a class each, so that the second factor is 1; the others share `SHARED`
classes by hash, and there P(word | class) = (n + `UNSEEN`) / (tokens + `UNSEEN` * (words + 1)), where n is the count of
the word, tokens and words are those of the class, and a word that the corpus lacks has n = 0.  The network
predicts the class of a masked word from the two words on either side; a document's score is the sum of the
log-probabilities of all its words.

Training has two steps.  A bounded sample (the `WARM_DOCUMENTS` texts first by a hash, of those of `WARM_TOKENS` words at most) gives
first weights on the driver.  Then the corpus, as classes of one byte a word, is dealt into shards of about `SHARD_TOKENS` words
by a hash of key and text.  Every shard goes on from the first weights, with every word as a target, in the order of that hash, and the
shards' weights are averaged by the number of targets, in two levels of a fixed width and order.  So the model does not depend on
how rows are dealt to tasks.

Scoring takes counts of the most frequent words (at most `HEAD`) from a broadcast table of that size; all others
meet the written table by a shuffle of the distinct words of each text.

Defined results: null and empty texts have no tokens, pll 0 and no mean.  Rows that repeat are scored each;
extra columns are ignored.  An empty table is scored to an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.kernels import mix, word_slices
from quadweave.llm.scratch import released, small_batches, written

FREQUENT = 128
SHARED = 32
WINDOW = 2
WIDTH = 16
HIDDEN = 32
WARM_DOCUMENTS = 256
WARM_TOKENS = 1 << 16
SHARD_TOKENS = 1 << 18
WARM_PASSES = 8
WARM_BATCH = 256
BATCH = 2048
RATE = 0.05
MERGERS = 16
COUNT_AT_ONCE = 1 << 21
HEAD = 1 << 17
UNSEEN = 0.5
CLASSES = FREQUENT + SHARED
PAD = CLASSES
U = np.uint64


class Network:
    """Embeddings of the neighbours, one hidden layer, a softmax over classes; plain numpy."""

    PARTS = ("embed", "into", "bias", "out", "prior")

    def __init__(self, seed: int = 1):
        random = np.random.default_rng(seed)
        self.embed = random.normal(0, 1, (CLASSES + 1, WIDTH)).astype(np.float32)
        self.into = random.normal(0, 1 / np.sqrt(2 * WINDOW * WIDTH), (2 * WINDOW * WIDTH, HIDDEN)).astype(np.float32)
        self.bias = np.zeros(HIDDEN, np.float32)
        self.out = random.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32)
        self.prior = np.zeros(CLASSES, np.float32)
        self.squares = {name: np.full_like(getattr(self, name), 1e-6) for name in self.PARTS}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.PARTS])

    @classmethod
    def of(cls, flat: np.ndarray, squares: dict[str, np.ndarray] | None = None) -> Network:
        made, at = cls(), 0
        for name in cls.PARTS:
            p = getattr(made, name)
            setattr(made, name, flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        if squares is not None:
            made.squares = {name: s.copy() for name, s in squares.items()}
        return made

    def _step(self, name: str, gradient: np.ndarray, rate: float, rows=slice(None)) -> None:
        """Steps shrink with the squared gradients that a weight has seen, so that rare classes learn as well."""
        squares = self.squares[name]
        squares[rows] += gradient * gradient
        getattr(self, name)[rows] -= rate * gradient / np.sqrt(squares[rows])

    def train(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent, with a rate of its own for each weight."""
        n = len(target)
        x = self.embed[context].reshape(n, -1)
        h = np.tanh(x @ self.into + self.bias)
        z = h @ self.out + self.prior
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), target] -= 1
        p /= n
        back = (p @ self.out.T) * (1 - h * h)
        dx = (back @ self.into.T).reshape(n, 2 * WINDOW, WIDTH)
        self._step("out", h.T @ p, rate)
        self._step("prior", p.sum(0), rate)
        self._step("into", x.T @ back, rate)
        self._step("bias", back.sum(0), rate)
        # Steps of the same embedding are summed before they are applied.
        own = context.ravel().astype(np.uint8)  # as bytes they are sorted by radix
        order = np.argsort(own, kind="stable")
        own = own[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        self._step("embed", np.add.reduceat(dx.reshape(-1, WIDTH)[order], first), rate, own[first])

    def scorer(self):
        """A function from context classes and targets to log-probabilities."""
        slots = [self.embed @ self.into[j * WIDTH : (j + 1) * WIDTH] for j in range(2 * WINDOW)]

        def score(context: np.ndarray, target: np.ndarray) -> np.ndarray:
            h = slots[0][context[:, 0]] + self.bias
            for j in range(1, 2 * WINDOW):
                h += slots[j][context[:, j]]
            z = np.tanh(h) @ self.out
            z += self.prior
            own = z[np.arange(len(z)), target]
            top = z.max(1)
            z -= top[:, None]
            return own - top - np.log(np.exp(z, out=z).sum(1))

        return score


def classes(words: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Class of every word hash; `frequent` is sorted, `place` has the class of each."""
    rest = (FREQUENT + (mix(words) % U(SHARED)).astype(np.int64)).astype(np.int64)
    if not len(frequent) or not len(words):
        return rest
    at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
    return np.where(frequent[at] == words, place[at], rest)


def contexts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Classes around every token; beyond the ends of its text there is padding."""
    n = len(ids)
    row_start, row_end = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    out = np.full((n, 2 * WINDOW), PAD, np.int64)
    at = np.arange(n)
    for slot, step in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        to = at + step
        inside = (to >= row_start) & (to < row_end)
        out[inside, slot] = ids[to[inside]]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def counted():
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "cnt"])

    for batch in batches:
        for _, _, words, _, _ in word_slices(batch.column(0)):
            held.append(words)
            size += len(words)
            if size >= COUNT_AT_ONCE:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, cnt) of every word of the corpus, written."""
    return written(df.select(text).mapInArrow(_count, "word bigint, cnt bigint").groupBy("word").agg(F.sum("cnt").alias("cnt")), "words")


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words of the whole corpus, sorted, and their classes."""
    top = counts.orderBy(F.desc("cnt"), "word").limit(FREQUENT).collect()
    words = np.array([r["word"] for r in top], np.int64).view(U)
    order = np.argsort(words)
    return words[order], order.astype(np.int64)


def class_sizes(counts: DataFrame, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log of the denominator of P(word | class), by class; 0 for classes of one frequent word."""

    def run(batches):
        for batch in batches:
            own = classes(batch.column(0).to_numpy().view(U), frequent, place)
            tokens = np.bincount(own, weights=batch.column(1).to_numpy(), minlength=CLASSES).astype(np.int64)
            columns = [np.arange(CLASSES), tokens, np.bincount(own, minlength=CLASSES)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["class", "tokens", "words"])

    sums = counts.mapInArrow(run, "class bigint, tokens bigint, words bigint").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    out = np.full(CLASSES, np.log(UNSEEN))
    for r in sums.collect():  # CLASSES rows
        out[r["class"]] = np.log(r["tokens"] + UNSEEN * (r["words"] + 1))
    out[:FREQUENT] = 0
    return out


def head_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of all words above a count that leaves at most `HEAD`."""
    level = F.floor(8 * F.log2("cnt"))
    left, least = HEAD, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 8 rows for each doubling
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, U), np.zeros(0, np.int64)
    table = counts.where(level >= least).toArrow()
    words = table["word"].to_numpy().view(U)
    order = np.argsort(words)
    return words[order], table["cnt"].to_numpy()[order]


def _warm(texts: list[np.ndarray]) -> Network:
    """First weights from the classes of some texts."""
    network, random = Network(), np.random.default_rng(2)
    seen = np.ones(CLASSES)
    for ids in texts:
        seen += np.bincount(ids, minlength=CLASSES)
    network.prior = np.log(seen / seen.sum()).astype(np.float32)  # the frequencies are not left to be learnt
    for _ in range(WARM_PASSES):
        for ids, around in _together(texts):
            order = random.permutation(len(ids))
            for at in range(0, len(order), WARM_BATCH):
                part = order[at : at + WARM_BATCH]
                network.train(around[part], ids[part], RATE)
    return network


def _together(texts, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes and contexts of texts, about `most` words at a time; texts are whole."""
    held, size = [], 0
    for ids in texts:
        held.append(ids.astype(np.int64))
        size += len(ids)
        if size >= most:
            yield _joined(held)
            held, size = [], 0
    if size:
        yield _joined(held)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate(texts)
    return ids, contexts(ids, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def _encoder(shared):
    """(place, ids, n): the classes of each text as bytes; texts without words are left out."""

    def run(batches):
        frequent, place = shared.value
        for batch in batches:
            rows, ids, sizes = [], [], []
            for i, j, words, bounds, _ in word_slices(batch.column(1)):
                own = classes(words, frequent, place).astype(np.uint8)
                for r in range(j - i):
                    if bounds[r] < bounds[r + 1]:
                        rows.append(i + r)
                        ids.append(own[bounds[r] : bounds[r + 1]].tobytes())
                        sizes.append(len(ids[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64())], ["place", "ids", "n"])

    return run


_WEIGHTS = "shard bigint, targets bigint, weights binary"


def _weights(shard: int, targets: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([targets], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["shard", "targets", "weights"])


def _by_shard(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows (shard, *names) that come in the order of shards, by shard; one row is held."""
    rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in ("shard", *names)), strict=True))
    return ((shard, (row[1:] for row in own)) for shard, own in groupby(rows, key=lambda row: row[0]))


def _trainer(shared):
    def run(batches):
        flat, squares = shared.value
        for shard, rows in _by_shard(batches, "ids"):
            network, random, seen = Network.of(flat, squares), np.random.default_rng(3), 0
            for ids, around in _together(np.frombuffer(r[0], np.uint8) for r in rows):
                targets = random.permutation(len(ids))
                for at in range(0, len(targets), BATCH):
                    part = targets[at : at + BATCH]
                    network.train(around[part], ids[part], RATE)
                seen += len(targets)
            yield _weights(shard, seen, network.flat().astype(np.float64))

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, rows in _by_shard(batches, "targets", "weights"):
        total, seen = 0.0, 0
        for n, weights in rows:
            total, seen = total + np.frombuffer(weights) * n, seen + n
        yield _weights(shard, seen, total / seen)


def fit(df: DataFrame, key: str, text: str):
    """(weights, frequent words, their classes, counts of all words) for a corpus."""
    spark = df.sparkSession
    counts = word_counts(df, text)
    frequent, place = frequent_words(counts)
    known = spark.sparkContext.broadcast((frequent, place))
    rows = df.where(F.col(text).isNotNull()).select(F.xxhash64(key, text).alias("place"), F.col(text).alias("text"))
    encoded = written(rows.mapInArrow(released(_encoder(known)), "place bigint, ids binary, n bigint"), "classes")
    # Which rows are the sample is decided by the hash; of equal ones it does not matter which.
    sample = encoded.where(F.col("n") <= WARM_TOKENS).orderBy("place", "n").limit(WARM_DOCUMENTS).select("ids").collect()
    warm = _warm([np.frombuffer(bytes(r["ids"]), np.uint8) for r in sample])
    shared = spark.sparkContext.broadcast((warm.flat(), warm.squares))
    total = encoded.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    shards = max(1, -(-total // SHARD_TOKENS))
    dealt = encoded.select(F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"), "place", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "place", "ids")
    parts = dealt.select("shard", "ids").mapInArrow(released(_trainer(shared)), _WEIGHTS)
    merged = parts.withColumn("merger", F.col("shard") % MERGERS).repartition(MERGERS, "merger").sortWithinPartitions("merger", "shard")
    found = merged.select(F.col("merger").alias("shard"), "targets", "weights").mapInArrow(_average, _WEIGHTS).collect()  # MERGERS networks at most
    total, seen = np.zeros(len(warm.flat())), 0
    for row in sorted(found, key=lambda r: r["shard"]):
        total, seen = total + np.frombuffer(bytes(row["weights"])) * row["targets"], seen + row["targets"]
    return (total / seen if seen else warm.flat()), frequent, place, counts


def _rare(row: np.ndarray, words: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """For every row its distinct words and how often each stands there, as lists."""
    order = np.lexsort((words, row))
    row, words = row[order], words[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (words[1:] != words[:-1])]))
    times = np.diff(np.append(first, len(row)))
    offsets = pa.array(np.searchsorted(row[first], np.arange(rows + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(words[first].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times))


def score(df: DataFrame, key: str = "doc_id", text: str = "text", model=None) -> DataFrame:
    """`key`, `n_tokens`, `pll` (sum of conditional log-probabilities) and `mean_pll` of every row."""
    small_batches(df.sparkSession)
    flat, frequent, place, counts = fit(df, key, text) if model is None else model
    shared = df.sparkSession.sparkContext.broadcast((flat, frequent, place, class_sizes(counts, frequent, place), *head_counts(counts)))

    def run(batches):
        flat, frequent, place, sizes, head, times = shared.value
        probability, known = Network.of(flat).scorer(), np.log(times + UNSEEN)
        for batch in batches:
            counts, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            rare_rows, rare_words = [np.zeros(0, np.int64)], [np.zeros(0, U)]
            for i, j, words, bounds, _ in word_slices(batch.column(2), 1 << 18):
                ids = classes(words, frequent, place)
                around = contexts(ids, bounds)
                row = np.repeat(np.arange(j - i), np.diff(bounds))
                for at in range(0, len(ids), BATCH):
                    part = slice(at, at + BATCH)
                    sums[i:j] += np.bincount(row[part], weights=probability(around[part], ids[part]), minlength=j - i)
                counts[i:j] = np.diff(bounds)
                # P(word | class), but for the logarithms of counts that are in the written table alone.
                shares = -sizes[ids]
                others = np.flatnonzero(ids >= FREQUENT)
                at = np.minimum(np.searchsorted(head, words[others]), max(len(head) - 1, 0))
                found = head[at] == words[others] if len(head) else np.zeros(len(others), bool)
                shares[others[found]] += known[at[found]]
                sums[i:j] += np.bincount(row, weights=shares, minlength=j - i)
                rare_rows.append(i + row[others[~found]])
                rare_words.append(words[others[~found]])
            lists = _rare(np.concatenate(rare_rows), np.concatenate(rare_words), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(sums), *lists], ["row", "__key", "n_tokens", "pll", "words", "times"])

    # Rows are numbered, since keys may repeat or be null; the numbers are written with what belongs to them.
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    scored = written(rows.mapInArrow(run, f"row bigint, `__key` {kind}, n_tokens bigint, pll double, words array<bigint>, times array<bigint>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    more = F.sum(F.col("times") * F.log(F.coalesce("cnt", F.lit(0)) + UNSEEN))
    added = rare.join(counts, "word", "left").groupBy("row").agg(more.alias("more"))
    pll = F.col("pll") + F.coalesce("more", F.lit(0.0))
    return scored.join(added, "row", "left").select(F.col("__key").alias(key), "n_tokens", pll.alias("pll"), F.when(F.col("n_tokens") > 0, pll / F.col("n_tokens")).alias("mean_pll"))
