"""Differences between graph tables, and a digest of their content."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.model import COLUMNS, ORDER, TYPE

_SAME = ("ID", "KEY", "VALUE")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts that one side lacks: _merge is left_only or right_only; nulls are equal."""

    def only(a: DataFrame, b: DataFrame, mark: str) -> DataFrame:
        other = b.select(*(F.col(c).alias(f"_{c}") for c in _SAME)).distinct()
        rows = a.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SAME], "left_anti")
        none = F.lit(None).cast("string")
        sides = (F.col("INSTANCE_ID"), none) if mark == "left_only" else (none, F.col("INSTANCE_ID"))
        return rows.select(*_SAME, sides[0].alias("INSTANCE_ID_OLD"), sides[1].alias("INSTANCE_ID_NEW"), F.lit(mark).alias("_merge"))

    return only(old, new, "left_only").unionByName(only(new, old, "right_only"))


def diff_by_instance(data: DataFrame, first: str, second: str) -> DataFrame:
    """Facts of two instances of one table that occur exactly once among both."""
    rows = data.where(F.col("INSTANCE_ID").isin(first, second))
    once = rows.groupBy(*_SAME).agg(F.count("*").alias("n"), F.first("INSTANCE_ID").alias("INSTANCE_ID")).where("n = 1")
    return once.select(*COLUMNS)


def diff_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(ID, place, line) of all differences: for each object its head (place 0), then - for old and + for new, by property."""
    rows = diff(old, new)
    names = rows.where(F.col("KEY") == TYPE).groupBy("ID").agg(F.max("VALUE").alias("class"))
    heads = rows.select("ID").distinct().join(names, "ID", "left").select("ID", F.struct(F.lit(0).alias("kind"), F.lit("").alias("key"), F.lit("").alias("side"), F.lit("").alias("value")).alias("place"), F.concat(F.lit("@@ "), F.coalesce("class", F.lit("object")), F.lit(" "), "ID").alias("line"))
    value = F.coalesce("VALUE", F.lit(""))
    facts = rows.select("ID", F.struct(F.lit(1).alias("kind"), F.col("KEY").alias("key"), F.col("_merge").alias("side"), value.alias("value")).alias("place"), F.concat(F.when(F.col("_merge") == "left_only", "-").otherwise("+"), F.lit(" "), "KEY", F.lit(": "), value).alias("line"))
    return heads.unionByName(facts)


def write_diff(old: DataFrame, new: DataFrame, folder: str) -> None:
    """All differences as text, in files that follow each other by object; however many there are."""
    diff_lines(old, new).repartitionByRange("ID").sortWithinPartitions("ID", "place").select(F.col("line").alias("value")).write.text(folder)


def diff_text(old: DataFrame, new: DataFrame, most: int = 10_000) -> str:
    """The differences as one text on the driver, for people; more than `most` lines are an error, and go to `write_diff`."""
    rows = diff_lines(old, new).orderBy("ID", "place").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lines of differences; write them with write_diff")
    return "\n".join(r["line"] for r in rows)


def row_hash(columns=COLUMNS):
    """A hash in which null and empty text differ, and no value can run into the next."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.length(F.coalesce(F.col(c), F.lit(""))), F.coalesce(F.col(c), F.lit("")))]
    return F.xxhash64(*parts)


def content_hash(data: DataFrame, ignore_types=("Distribution", "NamespaceMap"), columns=COLUMNS, order_sensitive: bool = False) -> str:
    """A digest of the rows: the order counts only if asked for; objects of volatile classes do not count."""
    if ignore_types:
        volatile = data.where((F.col("KEY") == TYPE) & F.col("VALUE").isin(list(ignore_types))).select("ID")
        data = data.join(volatile, "ID", "left_anti")
    own = row_hash((*columns, ORDER) if order_sensitive else columns)
    r = data.select(own.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return hashlib.blake2b(f"{r['n']}:{r['s']}:{r['x']}".encode(), digest_size=16).hexdigest()
