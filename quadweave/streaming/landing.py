"""Graph tables that grow: files that land in a folder are appended once each, or merged as changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadweave.functions.terms import facts_of_quads
from quadweave.model import SCHEMA


def append_new(stream: DataFrame, table: str, progress: str) -> None:
    """Appends what a stream of facts has that was not taken before, then ends; `progress` remembers the place."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def quads_landing(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the facts of N-Quads files that land in a folder."""
    return facts_of_quads(spark.readStream.text(folder))


def facts_landing(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the facts of Parquet files that land in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def each_batch(stream: DataFrame, merge: Callable[[DataFrame, int], None], progress: str) -> None:
    """Calls `merge` with every batch of changes and its number; a batch that is seen again has the same number."""
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
