"""Tables written between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Rows that a task gets where tables are dealt by the number of their rows.
ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset and the master local (tests), a folder of this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quadweave-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder at which nothing is yet; what comes to be there goes when the driver ends."""
    where = f"{shared_folder(spark)}/quadweave/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    fs.deleteOnExit(path)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it back: it is computed once, its plan ends there, and lost executors take nothing of it."""
    where = new_path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def tasks_for(df: DataFrame) -> int:
    """Tasks for the rows of a table, which are counted, at ROWS a task; 0 for tables that need not be dealt by rows.

    Spark deals by bytes of what is shuffled, which are packed so well here that millions of rows would be sorted in one task."""
    tasks = -(-df.count() // ROWS)
    return tasks if tasks > df.sparkSession.sparkContext.defaultParallelism else 0
