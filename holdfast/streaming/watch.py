"""A directory watcher as a stream: new files are listed as they arrive (deletions and renames are not emitted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import dispatch, paths


def watch(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """Stream of path, length, name, ext, signature, content of new files."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    name = paths.file_name(F.col("path"))
    out = raw.select("path", "length", F.col("modificationTime").alias("modified"), name.alias("name"), paths.extension(F.col("path")).alias("ext"), dispatch.signature(F.col("content")).alias("signature"), "content")
    return out.filter(paths.matches(F.col("name"), mask)) if mask else out


def listed(stream: DataFrame, readers: dict | None = None) -> DataFrame:
    """Member rows of containers in the stream."""
    from holdfast.sources.containers import list_members

    return list_members(stream, readers=readers)


def run_once(stream: DataFrame, name: str, checkpoint: str) -> None:
    """Handles what is there now and stops; the rows are in the table `name`."""
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
