"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: list[str] = []
#: Folders of written tables that are not dropped.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Bytes of a row group, which the task that writes it holds; Spark's default is 128 MB.
ROW_GROUP = 16 << 20
#: Shuffle files go when the execution that needs them ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset (tests), a folder of this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quadweave-"))
    return _own[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    where = f"{shared_folder(spark)}/quadweave/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    folder = new_folder(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/table")
    table = spark.read.schema(df.schema).parquet(f"{folder}/table")
    _folders[table] = folder
    return table


def narrowed(table: DataFrame, *names: str) -> DataFrame:
    """Some columns of a written table, which from now on is dropped by this name."""
    narrow = table.select(*names)
    _folders[narrow] = _folders.pop(table)
    return narrow


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read any more; others (what is derived from a written table, too) stay as they are."""
    for table in tables:
        if folder := _folders.pop(table, None):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def private(df: DataFrame, *names: str, taken: tuple[str, ...] = ()) -> list[str]:
    """Names for working columns that no column of df has, and that are not taken otherwise, whatever the case."""
    taken = {c.lower() for c in [*df.columns, *taken]}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns, also those with dots in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


#: Rows and bytes of an Arrow batch; Spark's defaults are too much for whole texts, in a worker and outside the heap of its executor.
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 20
#: Rows that a Parquet reader holds at once, on the heap; Spark's default of 4,096 is too much for long texts and sets of shingles.
READ_ROWS = 512
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of batches, for columns of whole texts; lower settings stay."""
    for name, most in _LIMITS.items():
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def _returned() -> None:
    """Gives memory that is free in this process back to the system, where the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """A function of Arrow batches that gives unused memory back when its task ends: workers live on."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _returned()

    return whole
