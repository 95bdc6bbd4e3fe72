"""Tables of objects, a CSV folder for each class, as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.model import TYPE
from quadweave.operators.tableview import facts_of_view


def read_tables(spark: SparkSession, paths: dict[str, str], instance_id: str | None = None) -> DataFrame:
    """Facts of CSV tables by class; empty cells are no facts, the class is added where a table has no Type."""
    found = None
    for name, path in paths.items():
        view = spark.read.csv(path, header=True, multiLine=True, escape='"')
        if TYPE not in view.columns:
            view = view.withColumn(TYPE, F.lit(name))
        rows = facts_of_view(view, instance_id)
        found = rows if found is None else found.unionByName(rows)
    return found
