"""Byte, checksum and text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast.functions import bytesfn as bf
from holdfast.functions import codecs, text
from holdfast.plans.registry import query, table


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes FROM documents")
def md5_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("SELECT p_partkey, CAST(ascii(substr(p_name, 1, 1)) + 256 * ascii(substr(p_name, 2, 1)) AS BIGINT) AS le16, CAST(256 * ascii(substr(p_name, 1, 1)) + ascii(substr(p_name, 2, 1)) AS BIGINT) AS be16, starts_with(p_name, 'Pa') AS is_pa FROM part")
def magic_signature(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("b", F.encode("p_name", "UTF-8"))
    return p.select("p_partkey", bf.unsigned_le(F.col("b"), 0, 2).alias("le16"), bf.unsigned_be(F.col("b"), 0, 2).alias("be16"), bf.ascii_equal(F.col("b"), 0, "Pa").alias("is_pa"))


@query("SELECT l_orderkey, l_linenumber, ((l_orderkey << 5) | (l_orderkey >> 27)) & 4294967295 AS rot_left, ((l_orderkey >> 7) | (l_orderkey << 25)) & 4294967295 AS rot_right FROM lineitem")
def bit_rotation(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", bf.rotate_left(F.col("l_orderkey"), 5, 32).alias("rot_left"), bf.rotate_right(F.col("l_orderkey"), 7, 32).alias("rot_right"))


@query("""SELECT doc_id, NOT regexp_matches(substr(text, 1, 1024), '[\\x00-\\x08\\x0E-\\x1A\\x1C-\\x1F]') AND (contains(substr(text, 1, 1024), chr(10)) OR octet_length(encode(text)) < 80) AS is_text, 'default' AS encoding FROM documents""")
def text_sniff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.substring("text", 1, 1024), "UTF-8").alias("head"), F.encode("text", "UTF-8").alias("b"))
    return d.select("doc_id", text.is_text(F.col("head"), F.octet_length("b")).alias("is_text"), text.guess_encoding(F.col("b")).alias("encoding"))


@query("SELECT p_partkey, CAST(p_size * 100 * 2 * 16 // 8 AS BIGINT) AS bytes_per_second, CAST(p_size * 100 * 2 * 16 AS BIGINT) AS bitrate, CAST(p_size * ((24 + 7) // 8) AS BIGINT) AS stride FROM part")
def wave_and_stride(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rate = F.col("p_size").cast("bigint") * 100
    return p.select("p_partkey", bf.bytes_per_second(rate, F.lit(2), F.lit(16)).alias("bytes_per_second"), (bf.bytes_per_second(rate, F.lit(2), F.lit(16)) * 8).alias("bitrate"), bf.stride(F.col("p_size").cast("bigint"), F.lit(24)).alias("stride"))


@query("SELECT doc_id, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def longest_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_max(F.transform(F.split("text", "\n"), F.length)).cast("bigint").alias("longest"))


@query()
def checksums(spark, sf_dir):
    """Checksums that the SQL engine lacks; tests/test_functions.py compares them with references."""
    b = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(b).alias("crc32"), codecs.checksum("adler32")(b).alias("adler32"), codecs.checksum("crc16")(b).alias("crc16"), codecs.checksum("crc64")(b).alias("crc64"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS zlib, true AS lzss, true AS xor FROM documents")
def compress_roundtrip(spark, sf_dir):
    b = F.encode("text", "UTF-8")
    d = table(spark, sf_dir, "documents").select("doc_id", b.alias("b"))
    back = lambda name, **o: codecs.decode(name, **o)(codecs.encode(name, **o)(F.col("b"))) == F.col("b")
    return d.select("doc_id", F.octet_length("b").cast("bigint").alias("n_bytes"), back("zlib").alias("zlib"), back("lzss").alias("lzss"), back("xor", key=b"\x5a\x01").alias("xor"))


ROUND = ("gzip", "bz2", "zstd", "lzma", "lz4_block", "rle", "mtf")


@query("SELECT doc_id, " + ", ".join(f"md5(text) AS {x}" for x in ROUND) + " FROM documents")
def codec_roundtrips(spark, sf_dir):
    """What each codec gives back of what it packed, by digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return d.select("doc_id", *[F.md5(codecs.decode(x)(codecs.encode(x)(F.col("b")))).alias(x) for x in ROUND])


@query("SELECT doc_id, 'ZLIB' AS form, md5(text) AS md5, CAST(NULL AS VARCHAR) AS error FROM documents UNION ALL SELECT doc_id, 'plain', NULL, 'error' FROM documents")
def checked_decoding(spark, sf_dir):
    """A good stream gives its bytes, a bad one null and the reason, which stands for itself here by its first word."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    packed = d.select("doc_id", F.lit("ZLIB").alias("form"), codecs.encode("zlib")(F.col("b")).alias("b"))
    both = packed.unionByName(d.select("doc_id", F.lit("plain").alias("form"), F.concat(F.lit(b"\0\0"), "b").alias("b")))
    out = both.select("doc_id", "form", codecs.decode_checked("zlib")(F.col("b")).alias("r"))
    return out.select("doc_id", "form", F.md5("r.data").alias("md5"), F.substring_index("r.error", ":", 1).alias("error"))
