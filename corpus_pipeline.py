"""A corpus pipeline: language, near copies, benchmark passages, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last
return the columns of `documents`; further columns of docs, whatever their names, go along unchanged, and so does
the order of columns.  An empty table gives an empty table.  Decisions fall on rows, by doc_id and text together: rows that share
a doc_id but not their text are judged each by its own text, and rows without doc_id like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadweave.llm import bpe, jaccard_join, language, pii, tiling
from quadweave.llm.scratch import columns, private, written

#: Corrected share of n-grams below which a text is in none of the languages.
LEAST_SHARE = 0.25
#: Ids up to which a list of rows to leave out is broadcast; beyond it, it is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Where the keys of rows whose doc_id does not name one text begin: behind those of all others.
_BEHIND = 1 << 62


def _sized(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _with_key(docs: DataFrame, key: str) -> DataFrame:
    """docs with a key of doc_id and text: doc_id itself, but a hash of both where it is null or stands with several texts."""
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("least"), F.max(text).alias("most")).where("least < most")
    several = _sized(written(several.select("doc_id", F.lit(True).alias("several")), "several-texts"))
    (flag,) = private(docs, "__several")
    marked = docs.join(several.withColumnRenamed("several", flag), "doc_id", "left")
    hashed = F.lit(_BEHIND) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit(_BEHIND - 1))
    return marked.select(*columns(docs), F.when(F.col("doc_id").isNull() | F.col(flag).isNotNull(), hashed).otherwise(F.col("doc_id").cast("bigint")).alias(key))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones as well), and those that are in none of the corpus's languages.

    Repeated rows are judged alike.  Without labelled rows no language is known, and no row stays."""
    held_out, lang, score = private(docs, "__held_out", "__lang_pred", "__score")
    found = language.annotated(docs, names=(held_out, lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SHARE)).select(columns(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group: five-word shingles, similarity 0.8 or more.

    Rows whose doc_id is null or stands with several texts come behind all others.  Of rows with the same doc_id and text one
    stays, that with the smallest hash of its columns.  Texts without words, null ones too, are copies of nothing: all stay."""
    (key,) = private(docs, "__row_key")
    keyed = _with_key(docs, key)
    found = jaccard_join.jaccard_components(keyed.select(key, "text"), k=5, percent=80, key=key)
    groups = written(found.where("n_shingles > 0").select(F.col(key).alias("row"), "component_id"), "groups")
    left_out = written(groups.where("row <> component_id").select(F.col("row").alias(key)).distinct(), "left-out")
    kept = keyed.join(_sized(left_out), key, "left_anti")
    again = written(groups.where("row = component_id").groupBy("row").count().where(F.col("count") > 1).select(F.col("row").alias(key)), "again")
    if again.isEmpty():
        return kept.select(columns(docs))
    (place,) = private(keyed, "__place")
    again, names = _sized(again), columns(docs)
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*names)))
    once = kept.join(again, key, "left_semi").withColumn(place, first).where(F.col(place) <= 1)
    return kept.join(again, key, "left_anti").select(names).unionByName(once.select(names))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds half of a benchmark item or more, in any order of its passages; null and empty texts stay."""
    (key,) = private(docs, "__row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    leaked = tiling.leaks(keyed.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key)
    leaked = written(leaked.select(F.col("doc_id").alias(key)).distinct(), "leaked")
    return keyed.join(_sized(leaked), key, "left_anti").select(columns(docs))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and removes terms that disclose it; n_chars follows the text.

    Null and empty texts stay as they are (n_chars is null for a null text); repeated rows are changed alike."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(columns(docs))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text, for every row; a null text has no ids."""
    import public_tokenizers

    return bpe.tokenised(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", sanitised),
    ("tokens", tokenised),
]

#: SQL can't express the tiling, the sanitising by PMI or the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
