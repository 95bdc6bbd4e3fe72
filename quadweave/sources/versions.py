"""Tables that are replaced whole, or added to, at one moment: versions with one published number.

A version is a folder of Parquet below `versions`; `published` has a small file for each number, which names the folders that make up the table.  A
writer writes its folder first and then creates the file of the next number, which only one writer can: readers see the table before or
after, whole.  A reader keeps the folders that it found when it began, until `clean` removes those that no kept number names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer was first to publish."""


def _hadoop(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, where: str) -> list[str]:
    fs, path = _hadoop(spark, where)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def numbers(spark: SparkSession, table: str) -> list[int]:
    """The numbers that are published, in order."""
    return sorted(int(n) for n in _names(spark, f"{table}/published") if n.isdigit())


def _folders(spark: SparkSession, table: str, number: int) -> list[str]:
    fs, path = _hadoop(spark, f"{table}/published/{number}")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """The table as it is now, or as it was at a number that is kept."""
    known = numbers(spark, table)
    if not known:
        raise ValueError(f"nothing is published at {table}")
    return spark.read.parquet(*(f"{table}/versions/{f}" for f in _folders(spark, table, known[-1] if number is None else number)))


def _publish(spark: SparkSession, table: str, number: int, folders: list[str]) -> None:
    jvm = spark._jvm
    fs, path = _hadoop(spark, f"{table}/published/{number}")
    fs.mkdirs(path.getParent())
    # Written aside and renamed, so that nobody reads half of it; a rename onto a file that is there fails.
    aside = jvm.org.apache.hadoop.fs.Path(f"{table}/published/.{number}-{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(folders).encode()))
    stream.close()
    try:
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, path, options)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(path):
            raise Conflict(f"number {number} of {table} was published by another writer") from e
        raise


def _write(df: DataFrame, table: str, keep: bool) -> int:
    spark = df.sparkSession
    known = numbers(spark, table)
    before = _folders(spark, table, known[-1]) if known and keep else []
    folder = uuid.uuid4().hex
    df.write.parquet(f"{table}/versions/{folder}")
    number = (known[-1] if known else 0) + 1
    _publish(spark, table, number, [*before, folder])
    return number


def replace(df: DataFrame, table: str) -> int:
    """Makes df the whole table; returns its number.  A writer that published meanwhile makes it a Conflict, and nothing changes."""
    return _write(df, table, False)


def append(df: DataFrame, table: str) -> int:
    """Adds rows to the table as it was when this began."""
    return _write(df, table, True)


def clean(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Forgets all but the last `keep` numbers, and removes the folders that none of them names; returns those.

    Folders that are being written for the next number would go too: clean when no writer is at work."""
    known = numbers(spark, table)
    for number in known[: max(0, len(known) - keep)]:
        fs, path = _hadoop(spark, f"{table}/published/{number}")
        fs.delete(path, False)
    named = {f for n in numbers(spark, table) for f in _folders(spark, table, n)}
    gone = [f for f in _names(spark, f"{table}/versions") if f not in named]
    for folder in gone:
        fs, path = _hadoop(spark, f"{table}/versions/{folder}")
        fs.delete(path, True)
    return gone
