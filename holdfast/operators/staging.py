"""Intermediate tables in the folder that driver and executors share.

They are left for the folder's owner to clean, since a lazily read result may
still need them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For a shared folder that is mounted as a path: no process (chmod) and no checksum file for every file written.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def folder(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, on one machine only, below a temporary folder."""
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} is not set: executors of a cluster need a folder that all of them share")
        base = tempfile.mkdtemp(prefix="holdfast-checkpoint-")
        spark.conf.set(key, base)
    return f"{base.rstrip('/')}/holdfast-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes df to path and reads it back: lineage ends here."""
    df.write.options(**PLAIN_FILES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
