"""N-Quads and N-Triples files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadweave.functions.terms import CIM, facts_of_quads


def read_nquads(spark: SparkSession, paths, cim: str = CIM) -> DataFrame:
    """Facts of text files that Spark can read; lines are parsed where they lie."""
    return facts_of_quads(spark.read.text(paths), cim=cim)
