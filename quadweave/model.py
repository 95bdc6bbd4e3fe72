"""The graph table: one fact per row, all strings, and the order in which facts were loaded.

`ID` names an object, `KEY` a property, `VALUE` its text or the ID it refers to, `INSTANCE_ID` the source.
`_ord` orders facts: wherever "the first value" is asked for, it is the one with the smallest `_ord`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPE = "Type"
ORDER = "_ord"
COLUMNS = ("ID", "KEY", "VALUE", "INSTANCE_ID")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS] + [T.StructField(ORDER, T.LongType())])


def graph(spark: SparkSession, rows) -> DataFrame:
    """A graph table of (ID, KEY, VALUE, INSTANCE_ID) tuples, ordered as they come."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def require(data: DataFrame, columns=COLUMNS) -> DataFrame:
    """The named columns; an early error names those that are missing."""
    if missing := [c for c in columns if c not in data.columns]:
        raise ValueError(f"the table lacks {', '.join(missing)}; it has {', '.join(data.columns)}")
    return data.select(*columns)


def quoted(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def facts(data: DataFrame) -> DataFrame:
    """The graph columns; `_ord` is null where the table has none."""
    order = F.col(ORDER) if ORDER in data.columns else F.lit(None).cast("bigint").alias(ORDER)
    instance = F.col("INSTANCE_ID") if "INSTANCE_ID" in data.columns else F.lit(None).cast("string").alias("INSTANCE_ID")
    return data.select("ID", "KEY", "VALUE", instance, order)
