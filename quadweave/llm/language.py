"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: every position of the table holds a bit for each language,
so that one look-up of an n-gram gives all languages that contain it, as the AND of the masks at its
positions.  A text's n-grams (3 and 4 letters, with word borders) are counted by language; a share s of hits
in a filter that reports absent n-grams with probability f is corrected to (s - f) / (1 - f); the language
with the largest corrected share is predicted, and that share is the score.

The filters are fitted on a bounded sample of the labelled rows: about `SAMPLE` rows for each
language, taken by a hash of the row; an n-gram enters a filter if `SUPPORT` rows of the language have it, and any row where
fewer than `FEW` are sampled.  The table takes 128 KB a language.  Every text is then predicted from the whole of it.

Defined results: a null text, or one without letters, is `und` with score 0; so is every text if no row is
labelled.  Ties go to the language with more sampled rows, then to the smaller name.  Rows without key are
predicted, and are not held out.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.llm.kernels import mix
from quadweave.llm.scratch import released, small_batches

SAMPLE = 600
SUPPORT = 3
FEW = 10
POSITIONS = 1 << 20
HASHES = 2
SIZES = (3, 4)
SLICE_CHARS = 1 << 17
U = np.uint64
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """Some texts at a time as Python strings."""
    held, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        if held and size + len(text) > SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams of some texts, and how many letters each text has."""
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths + 1)
    row = np.concatenate([row[:1] if len(row) else np.zeros(1, np.int64), row])[: len(codes)]
    letter = _is_letter()[np.minimum(codes, 0x10FFFF)]
    letters = np.bincount(row[letter], minlength=len(texts))
    keep = letter.copy()  # of other characters, the first after a letter
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes, row, letter = np.where(letter, codes, 32)[keep].astype(U), row[keep], letter[keep]
    hashes, rows = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            count = len(codes) - n + 1
            if count <= 0:
                continue
            inner = np.ones(count, bool)
            total = np.full(count, U(n))
            for j in range(n):
                total = total * U(0x100000001B3) + codes[j : count + j]
                if 0 < j < n - 1:
                    inner &= letter[j : count + j]
            hashes.append(mix(total[inner]))
            rows.append(row[1 : count + 1][inner])
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64), letters
    return np.concatenate(hashes), np.concatenate(rows), letters


def positions(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> U(20 * i)) & U(POSITIONS - 1)).astype(np.int64) for i in range(HASHES)]


def fit(labelled: DataFrame, key: str, text: str, lang: str) -> tuple[list[str], list[np.ndarray]]:
    """Languages, and for every eight of them the masks by position."""
    spark = labelled.sparkSession
    sizes = labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()  # one row a language
    names = [r[0] for r in sizes]
    if not names:
        return [], []
    # A hash of the row decides, at the rate that gives SAMPLE rows of the language.
    rates = spark.createDataFrame([(r[0], min(1.0, SAMPLE / r[1])) for r in sizes], "lang_name string, rate double")
    place_of = F.pmod(F.xxhash64(key, text), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = labelled.join(F.broadcast(rates), F.col(lang) == F.col("lang_name")).where(place_of < F.col("rate"))
    place = {name: i for i, name in enumerate(names)}

    def run(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for text, name in zip(texts, langs, strict=True):
                if name in place:
                    found = np.unique(grams([text])[0]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), place[name], np.int32)), pa.array(found)], ["lang", "gram"])

    counted = sample.select(text, lang).mapInArrow(run, "lang int, gram bigint").groupBy("lang", "gram").count()
    supports = F.array(*(F.lit(1 if r[1] < FEW else SUPPORT) for r in sizes))
    counted = counted.where(F.col("count") >= F.get(supports, F.col("lang")))
    at = F.explode(F.array(*(F.shiftrightunsigned("gram", 20 * i).bitwiseAND(F.lit(POSITIONS - 1)) for i in range(HASHES)))).alias("position")
    bits = counted.select("lang", at).groupBy((F.col("lang") / 8).cast("int").alias("part"), "position").agg(F.bit_or(F.expr("shiftleft(1, lang % 8)")).alias("mask"))
    masks = [np.zeros(POSITIONS, np.uint8) for _ in range(-(-len(names) // 8))]
    table = bits.toArrow()  # POSITIONS rows for every eight languages at most
    for part in range(len(masks)):
        rows = table.filter(pa.array(table["part"].to_numpy() == part))
        masks[part][rows["position"].to_numpy()] = rows["mask"].to_numpy().astype(np.uint8)
    return names, masks


def predict(texts: list[str], names: list[str], masks: list[np.ndarray], rates: np.ndarray) -> tuple[list[str], np.ndarray]:
    hashes, rows, letters = grams(texts)
    total = np.bincount(rows, minlength=len(texts))
    shares = np.zeros((len(texts), len(names)))
    places = positions(hashes)
    for part, table in enumerate(masks):
        found = table[places[0]]
        for more in places[1:]:
            found &= table[more]
        for bit in range(min(8, len(names) - 8 * part)):
            hits = np.bincount(rows, weights=(found >> bit) & 1, minlength=len(texts))
            rate = rates[8 * part + bit]
            shares[:, 8 * part + bit] = (hits / np.maximum(total, 1) - rate) / (1 - rate)
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    best = shares.argmax(1)
    known = letters > 0
    scores = np.where(known, np.clip(shares[np.arange(len(texts)), best], 0, 1), 0.0)
    return [names[b] if k else "und" for b, k in zip(best, known, strict=True)], scores


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def annotated(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", names: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """All columns, with `held_out`, `lang_pred` and `score`, or as `names` has them; columns of these names are replaced.

    Held-out rows teach nothing; the text alone decides a prediction."""
    of_held_out, of_language, of_score = names
    small_batches(df.sparkSession)
    labelled = df.where(~held_out(F.col(key)) & F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(key, text, lang)
    languages, masks = fit(labelled, key, text, lang)
    rates = np.array([min(0.99, (((masks[i // 8] >> (i % 8)) & 1).mean()) ** HASHES) for i in range(len(languages))])
    shared = df.sparkSession.sparkContext.broadcast((languages, masks, rates))

    def run(batches):
        model = shared.value
        for batch in batches:
            found, scores = [], []
            for part in _slices(batch.column(place)):
                f, s = predict(part, *model)
                found += f
                scores.append(s)
            added = [pa.array(found, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score"])

    rows = df.drop(*names).withColumn(of_held_out, held_out(F.col(key)))
    place, numbered = rows.columns.index(text), rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))  # names with dots do not pass
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    found = numbered.mapInArrow(released(run), T.StructType(numbered.schema.fields + added))
    return found.toDF(*rows.columns, of_language, of_score)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`key`, `held_out`, `lang_pred` and `score` of every row."""
    return annotated(df.select(key, text, lang), key, text, lang).select(key, "held_out", "lang_pred", "score")
