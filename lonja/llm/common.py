"""Shared folder, materialised tables and word splitting for the text operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters (space, tab, \n, \v, \f, \r).
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that goes to a Python worker (a longer text stands alone).
BATCH_BYTES = 4 << 20
#: Paths of stored tables, for discard().
_STORED: dict[int, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set, a temporary one in local mode, as in tests;
    on a cluster that is an error, since executors do not share their disks."""
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's part of the shared folder, which the file system deletes when the driver ends."""
    top = f"{shared_dir(spark)}/lonja-{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def drop_at_end(spark: SparkSession, table: str) -> None:
    """Drops a catalog table when the driver ends, if the session still runs then."""

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session has ended, and a temporary catalog with it
            if spark.sparkContext._jsc is not None:
                spark.sql(f"DROP TABLE IF EXISTS {table}")

    atexit.register(drop)


def bounded_batches(spark: SparkSession) -> None:
    """Sets the bytes of an Arrow batch on its way to a Python worker to BATCH_BYTES, unless the session has less: rows
    are whole texts, and a batch of 10,000 long ones would fill a worker. Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with contextlib.suppress(Exception):  # a version without this setting
        if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors,
    and gives Spark the true size, so that it broadcasts the table only when it is small. The shuffle files of the write
    go with it."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = scratch(spark, name)
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = path
    weakref.finalize(out, _STORED.pop, id(out), None)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() returned and that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        if path := _STORED.pop(id(df), None):
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def trim() -> None:
    """Gives a Python worker's freed memory back to the system; workers are used again by later stages."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def words(text: Column) -> Column:
    """Array of the words of a text, empty for null. Native: one translate, one single-character split."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE[1:], " " * (len(WHITE_SPACE) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def only_word_chars(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")
