"""Containers built from the driver's rows, listed and opened again; media headers.

An archive holds the documents of one source and one thousand ids, so it stays
far below the member limit however many documents a source has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import bytesfn as bf
from holdfast.functions import media
from holdfast.operators import sink
from holdfast.plans.registry import query, table
from holdfast.sources import containers as cs

ARCHIVES = "SELECT source || '-' || doc_id // 1000 AS archive, lang || '/' || doc_id || '.txt' AS name, doc_id, coalesce(text, '') AS text FROM documents"
OPENED = f"SELECT archive, name, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS md5 FROM ({ARCHIVES})"


def rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat("source", F.lit("-"), F.expr("doc_id div 1000")).alias("archive"), F.col("doc_id").alias("ord"),
        F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"),
    )


def reopened(spark, sf_dir, tag, writer=None, name=None):
    r = rows(spark, sf_dir)
    r = r.withColumn("name", name) if name is not None else r
    files = sink.build(r, tag, writer).select(F.col("archive").alias("path"), "content")
    got = cs.open_members(cs.list_members(files, [tag]), files)
    return got.select(F.col("path").alias("archive"), "name", F.octet_length("data").cast("bigint").alias("n_bytes"), F.md5("data").alias("md5"))


@query(OPENED)
def zip_members(spark, sf_dir):
    return reopened(spark, sf_dir, "ZIP")


@query(OPENED)
def xp3_members(spark, sf_dir):
    return reopened(spark, sf_dir, "XP3")


@query(OPENED)
def sar_members(spark, sf_dir):
    return reopened(spark, sf_dir, "SAR")


@query(f"SELECT archive, CAST(doc_id AS VARCHAR) || '.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS md5 FROM ({ARCHIVES})")
def grouped_members(spark, sf_dir):
    return reopened(spark, sf_dir, "WILL", name=F.concat("ord", F.lit(".txt")))


@query(OPENED)
def record_layout_members(spark, sf_dir):
    return reopened(spark, sf_dir, "GENERIC/PACK", sink.build_layout(cs.LAYOUTS["GENERIC/PACK"]))


@query(f"SELECT archive, count(*) AS members, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_size, 'ZIP' AS tag FROM ({ARCHIVES}) GROUP BY archive")
def dispatch_and_list(spark, sf_dir):
    """All readers are tried on each file; the first that lists it wins."""
    files = sink.build(rows(spark, sf_dir), "ZIP").select(F.col("archive").alias("path"), "content")
    listed = cs.list_members(files)
    return listed.groupBy(F.col("path").alias("archive"), "tag").agg(F.count("name").alias("members"), F.sum("unpacked_size").alias("total_size"))


@query(f"""SELECT archive, arg_min(name, doc_id) AS first_name, CAST(min(doc_id) AS BIGINT) AS first_ord FROM ({ARCHIVES}) GROUP BY archive""")
def extraction_order(spark, sf_dir):
    """The member at the lowest offset of each archive."""
    files = sink.build(rows(spark, sf_dir), "SAR").select(F.col("archive").alias("path"), "content")
    listed = cs.list_members(files, ["SAR"]).groupBy("path").agg(F.min_by("name", "offset").alias("first_name"))
    return listed.select(F.col("path").alias("archive"), "first_name", F.regexp_extract("first_name", r"(\d+)\.txt$", 1).cast("bigint").alias("first_ord"))


@query("SELECT doc_id, md5(text) AS md5, CAST(3 AS BIGINT) AS parts FROM documents WHERE octet_length(encode(text)) >= 3")
def multi_part_members(spark, sf_dir):
    """Each document as one member over a container of three part files."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).withColumn("n", F.octet_length("b")).filter("n >= 3")
    third = F.floor(F.col("n") / 3)
    cut = lambda i: F.struct(F.lit(i).alias("part_no"), (third * i).alias("start"), (F.col("n") if i == 2 else third * (i + 1)).alias("end"))
    parts = d.select("doc_id", "b", F.explode(F.array(*[cut(i) for i in range(3)])).alias("p")).select("doc_id", "p.*", bf.slice_of(F.col("b"), F.col("p.start"), F.col("p.end") - F.col("p.start")).alias("content"))
    from holdfast.operators import layout

    e = d.select("doc_id", F.lit(0).cast("bigint").alias("offset"), F.col("n").cast("bigint").alias("stop"))
    met = layout.overlap_join(e, parts, ["doc_id"], ("offset", "stop"), ("start", "end"), 1 << 20)
    glue = F.aggregate(F.array_sort(F.collect_list(F.struct("part_no", "content"))), F.lit(b""), lambda a, x: F.concat(a, x.content))
    return met.groupBy("doc_id").agg(F.md5(glue).alias("md5"), F.count("*").alias("parts"))


@query("SELECT p_partkey, 'BMP' AS format, CAST(p_size AS BIGINT) AS width, CAST(p_partkey % 90 + 1 AS BIGINT) AS height, 24 AS bpp FROM part")
def image_headers(spark, sf_dir):
    """Bitmap heads packed as columns, read as metadata."""
    le = lambda x, n: bf.pack_le(x, n)
    zero = F.lit(0)
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(b"BM"), le(zero, 4), le(zero, 4), le(F.lit(54), 4), le(F.lit(40), 4), le(F.col("p_size"), 4), le(F.col("p_partkey") % 90 + 1, 4), le(F.lit(1), 2), le(F.lit(24), 2), le(zero, 4)).alias("b"))
    m = p.select("p_partkey", media.image_metadata(F.col("b")).alias("m"))
    return m.select("p_partkey", "m.format", "m.width", "m.height", "m.bpp")


@query("SELECT doc_id, 2 AS channels, CAST(22050 AS BIGINT) AS samples_per_second, CAST(octet_length(encode(text)) AS BIGINT) AS pcm_size, CAST(44 AS BIGINT) AS pcm_offset FROM documents")
def wave_headers(spark, sf_dir):
    """Texts as samples under a wave header packed as columns, read as audio metadata."""
    d = table(spark, sf_dir, "documents").select("doc_id", media.wav(F.encode("text", "UTF-8"), F.lit(2), F.lit(22050), F.lit(16)).alias("b"))
    return d.select("doc_id", media.audio_info(F.col("b")).alias("a")).select("doc_id", "a.channels", "a.samples_per_second", "a.pcm_size", "a.pcm_offset")


@query(f"SELECT archive, name, CASE WHEN rn > 1 THEN 'duplicate' END AS problem FROM (SELECT archive, name, row_number() OVER (PARTITION BY archive, lower(name) ORDER BY doc_id) AS rn FROM (SELECT source AS archive, lang || '.txt' AS name, doc_id FROM documents))")
def writer_checks(spark, sf_dir):
    """What a writer would leave out: second and later members of one name."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("archive"), F.concat("lang", F.lit(".txt")).alias("name"), F.col("doc_id").alias("ord"), F.lit(b"x").alias("data"))
    return sink.checked(d).select("archive", "name", "problem")


@query(f"""SELECT archive, name, CASE doc_id % 4 WHEN 1 THEN 'no decoder for method93x' WHEN 2 THEN 'beyond the end' END AS error,
 CASE WHEN doc_id % 4 NOT IN (1, 2) THEN md5(text) END AS md5 FROM ({ARCHIVES})""")
def opened_equals_listed(spark, sf_dir):
    """Every listed member comes back: of four, one has a packing that nobody knows and one stands beyond its file's end."""
    files = sink.build(rows(spark, sf_dir), "ZIP").select(F.col("archive").alias("path"), "content")
    no = F.regexp_extract("name", r"(\d+)\.txt$", 1).cast("bigint") % 4
    listed = cs.list_members(files, ["ZIP"])
    listed = listed.withColumn("packing", F.when(no == 1, "method93x").when(no == 2, F.lit(None)).otherwise(F.col("packing")))
    listed = listed.withColumn("offset", F.when(no == 2, F.lit(1 << 40)).otherwise(F.col("offset")))
    return cs.open_members(listed, files).select(F.col("path").alias("archive"), "name", "error", F.md5("data").alias("md5"))
