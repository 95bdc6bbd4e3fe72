"""Joins in which very many rows may share a key: such keys are broadcast, so that no task gets all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which on a key is hot, how many keys are (the most frequent), and the rows of the other table that they may meet.
HOT = 100_000
MOST_KEYS = 1_000
MOST_MATCHES = 200_000


def sized(table: DataFrame, most: int | None = None) -> DataFrame:
    """A written table for a join: sent to all tasks if it has at most `most` rows, else merged by sort.

    Spark guesses by the bytes of files, which hold far less than the rows read from them."""
    most = MOST_MATCHES if most is None else most
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table.hint("merge")


def joined(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows.join(table, on, how) for inner, left, left_semi and left_anti; both are read more than once, so they had better be written.

    Where hot keys meet more of the table than can be sent, it is a plain join."""
    spark = rows.sparkSession
    found = rows.groupBy(*on).count().where(F.col("count") >= HOT).orderBy(F.desc("count")).limit(MOST_KEYS).select(*on).na.drop().collect()  # a row a hot key
    if not found:
        return rows.join(table, on, how)
    keys = F.broadcast(spark.createDataFrame(found, rows.select(*on).schema))
    theirs = table.join(keys, on, "left_semi")
    if theirs.limit(MOST_MATCHES + 1).count() > MOST_MATCHES:
        return rows.join(table, on, how)
    return rows.join(keys, on, "left_anti").join(table, on, how).unionByName(rows.join(keys, on, "left_semi").join(F.broadcast(theirs), on, how))
