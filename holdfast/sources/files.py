"""Files as DataFrames: signature, extension, stem and directory columns over binaryFile.

content is a column like others: queries that do not use it do not read it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.window import Window

from holdfast.operators import dispatch, layout, paths

MAX_FILE = (1 << 31) - 16


def files(spark: SparkSession, path: str, recursive: bool = False, mask: str | None = None, max_file: int = MAX_FILE) -> DataFrame:
    """path, length, modified, content, name, dir, stem, ext, signature, error of each file.

    Files over max_file bytes, which a column cannot hold as a value, have null content and say so in error.

    mask is matched without case after the scan (the reader's own glob minds
    case). size is length, cut to what 32 bits hold.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    over = F.col("length") > max_file
    raw = raw.filter(~over).withColumn("error", F.lit(None).cast("string")).unionByName(
        raw.filter(over).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), F.concat(F.lit("over "), F.lit(max_file), F.lit(" bytes")).alias("error"))
    )
    p = F.col("path")
    out = raw.select(
        "path", "length", F.least("length", F.lit(layout.MAX_SIZE)).alias("size"), F.col("modificationTime").alias("modified"), "content",
        paths.file_name(p).alias("name"), paths.directory(p).alias("dir"), paths.stem(p).alias("stem"), paths.extension(p).alias("ext"), dispatch.signature(F.col("content")).alias("signature"), "error",
    )
    return out.filter(paths.matches(F.col("name"), mask)) if mask else out


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Directories first, then files, by name: one directory, not below."""
    deep = files(spark, path, recursive=True).select("path", "length")
    rest = F.regexp_extract("path", re.escape(path.rstrip("/") + "/") + "(.*)$", 1)
    rows = deep.select(rest.alias("name"), "length", F.col("path").alias("ord"))
    return paths.children(rows, "").orderBy(F.when(F.col("kind") == "directory", 0).otherwise(1), F.lower("name"))


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not empty, in order, of a side file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line")).filter("length(line) > 0")


def offset_list(spark: SparkSession, path: str) -> DataFrame:
    """offset, name, size from lines HEX[,NAME]; the last line without a name marks the end."""
    rows = text_list(spark, path).select("ord", F.conv(F.element_at(F.split("line", ","), 1), 16, 10).cast("bigint").alias("offset"), F.get(F.split("line", ","), F.lit(1)).alias("name"))
    w = Window.orderBy("ord")  # one small side file
    return rows.withColumn("size", F.lead("offset").over(w) - F.col("offset")).filter("name IS NOT NULL").drop("ord")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """version, url, notes of an update manifest's release, and one row per required assembly."""
    xml = spark.read.text(path, wholetext=True).select(F.from_xml("value", "Release STRUCT<Version: STRING, Url: STRING, Notes: STRING>, FormatsData ARRAY<STRUCT<FileVersion: STRING, Url: STRING, Requires: STRUCT<Assembly: ARRAY<STRUCT<_Name: STRING, _Version: STRING>>>>>", {}).alias("m"))
    return xml.select("m.Release.*", F.explode_outer("m.FormatsData").alias("f")).select("Version", "Url", "Notes", F.col("f.FileVersion").alias("file_version"), F.explode_outer("f.Requires.Assembly").alias("a")).select("Version", "Url", "Notes", "file_version", F.col("a._Name").alias("assembly"), F.col("a._Version").alias("needs"))


class SqliteSource(DataSource):
    """Rows of a query over a SQLite file that every executor can open.

    Options: path, table, columns (a DDL schema). Equality filters are pushed
    into the query.
    """

    @classmethod
    def name(cls) -> str:
        return "holdfast_sqlite"

    def schema(self):
        return self.options["columns"]

    def reader(self, schema):
        return _SqliteReader(schema, dict(self.options))


class _SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options, self.where = schema, options, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.where.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        import sqlite3

        quoted = lambda c: '"' + c.replace('"', '""') + '"'
        sql = f"SELECT {', '.join(quoted(f.name) for f in self.schema.fields)} FROM {quoted(self.options['table'])}"
        if self.where:
            sql += " WHERE " + " AND ".join(f"{quoted(c)} = ?" for c, _ in self.where)
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            yield from db.execute(sql, [v for _, v in self.where])


def sqlite(spark: SparkSession, path: str, table: str, columns: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("holdfast_sqlite").option("path", path).option("table", table).option("columns", columns).load()
