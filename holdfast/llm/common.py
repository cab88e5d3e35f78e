"""Shared helpers: reading tables, staging intermediate results, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than space, \t, \n, \v, \f and \r.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch where this library starts the job.
BATCH_BYTES = "8m"
#: For a shared folder that is mounted as a path: Hadoop's default there starts a process (chmod) for every file and
#: keeps a checksum file beside it. Other file systems do not look at these settings.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one in spark.checkpoint.dir. Only where that is unset (tests on
    one machine) a folder of our own takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors of a cluster need a folder that all of them share")
        base = tempfile.mkdtemp(prefix="holdfast-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here.

    A later stage that loses an executor rereads the files instead of
    recomputing what led to them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/holdfast-{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.options(**PLAIN_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_BYTES at most while the block runs: they count twice, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Gives a worker's free memory back to the system; workers live on after their tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


