"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quadweave.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(_documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadweave.llm import warc

    return warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadweave.llm import pii

    return pii.span_digests(_documents(spark, sf_dir))


def op4_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadweave.llm import covertree

    return covertree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0", k=5)


def op5_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadweave.llm import licenses

    return licenses.find(_documents(spark, sf_dir))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadweave.llm import pseudo_likelihood

    return pseudo_likelihood.score(_documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadweave.llm import jaccard_join

    return jaccard_join.jaccard_components(_documents(spark, sf_dir), k=3, percent=90)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quadweave.llm import token_counts

    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op9_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadweave.llm import language

    return language.identify(_documents(spark, sf_dir))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadweave.llm import tiling

    return tiling.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_gnat_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadweave.llm import vector_codes

    return vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quadweave.llm import hard_negatives

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), "id % 50 = 0")


def op13_discriminant_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadweave.llm import quality

    return quality.scored(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda item: int(item[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from quadweave.llm import sql

    return {"op2_warc_round_trip": sql.WARC, "op4_cover_tree_top_k": sql.TOP_K, "op5_license_windows": sql.LICENSES, "op7_jaccard_join": sql.JACCARD, "op11_gnat_codebooks": sql.CODEBOOKS, "op12_cover_tree_negatives": sql.NEGATIVES}
