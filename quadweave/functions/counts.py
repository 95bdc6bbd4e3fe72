"""Counts of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.model import TYPE


def types_count(data: DataFrame, contains: str | None = None, ignore_case: bool = True) -> DataFrame:
    """Distinct objects of every class, most first; optionally of the classes whose name contains a text."""
    types = data.where(F.col("KEY") == TYPE)
    if contains is not None:
        name = F.lower("VALUE") if ignore_case else F.col("VALUE")
        types = types.where(F.contains(name, F.lit(contains.lower() if ignore_case else contains)))
    return types.groupBy("VALUE").agg(F.countDistinct("ID").alias("count")).withColumnRenamed("VALUE", "type").orderBy(F.desc("count"), "type")


def type_shares(data: DataFrame, key: str) -> DataFrame:
    """Objects that have a property, by class: count, total of all classes, and percent."""
    having = data.where(F.col("KEY") == key).select("ID").distinct()
    types = data.where(F.col("KEY") == TYPE).select("ID", F.col("VALUE").alias("Type")).distinct().join(having, "ID", "left_semi")
    counts = types.groupBy("Type").agg(F.count("*").alias("count"))  # one row a class
    whole = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("TOTAL", whole).withColumn("percent", F.round(F.col("count") / F.col("TOTAL") * 100, 6))
