"""Which formats to try on a file, and in which order.

Pass 1 holds the formats filed under the file's signature, pass 2 those under
signature 0 that pass 1 lacks. Inside a pass, preferred tags (declared by the
surrounding container) come first, then an extension match, then kind,
priority and tag (the tag is this engine's tiebreak).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast import catalog
from holdfast.functions import bytesfn
from holdfast.operators import paths


def signature(content: Column) -> Column:
    """First four bytes as an unsigned little-endian number; null if there are fewer."""
    return bytesfn.unsigned_le(content, 0, 4)


def candidates(files: DataFrame, fmts: DataFrame, key: str = "path") -> DataFrame:
    """key, tag, rank for every format to try. files: key, signature, extension, preferred (array of tags)."""
    by_sig = catalog.lookup_side(catalog.signature_map(fmts).withColumnRenamed("type", "kind"))
    tries = files.select(key, "signature", "extension", "preferred", F.explode(F.array_distinct(F.array(F.col("signature"), F.lit(0).cast("bigint")))).alias("s"))
    met = tries.join(by_sig, tries.s == by_sig.signature).drop(by_sig.signature)
    met = met.withColumn("pass_no", F.when(F.col("s") == F.col("signature"), 1).otherwise(2))
    first = met.groupBy(key, "signature", "extension", "preferred", "tag", "kind", "priority").agg(F.min("pass_no").alias("pass_no"))
    ext = fmts.select(F.col("tag").alias("t_"), F.col("extensions").alias("own_"))
    first = first.join(catalog.lookup_side(ext), first.tag == F.col("t_"))
    order = [
        F.col("pass_no"),
        F.when(F.array_contains(F.coalesce("preferred", F.array().cast("array<string>")), F.col("tag")), 0).otherwise(1),
        F.when(F.array_contains("own_", F.col("extension")), 0).otherwise(1),
        catalog.kind_order("kind"),
        F.desc("priority"),
        F.col("tag"),
    ]
    return first.select(key, "tag", "kind", "pass_no", F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("rank"))


def first_success(tried: DataFrame, key: str = "path") -> DataFrame:
    """Of attempts (key, rank, tag, ok, ...), the first that succeeded."""
    w = Window.partitionBy(key).orderBy("rank")
    return tried.filter("ok").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def type_of_name(entries: DataFrame, fmts: DataFrame, alias: DataFrame | None = None, name_col: str = "name") -> DataFrame:
    """entries with type from the extension; '' if no format claims it."""
    types = catalog.lookup_side(catalog.type_of_extension(fmts, alias).select(F.col("extension").alias("e_"), F.col("type").alias("type")))
    rows = entries.withColumn("x_", paths.extension(F.col(name_col)))
    return rows.join(types, rows.x_ == F.col("e_"), "left").drop("x_", "e_").withColumn("type", F.coalesce("type", F.lit("")))


def detect_type(entries: DataFrame, fmts: DataFrame, sig_col: str = "signature") -> DataFrame:
    """entries with detected: the tag that a member's first bytes name without doubt, else null.

    0 names nothing; Ogg, wave and bitmap heads are known; any other signature
    must belong to exactly one format.
    """
    sole = catalog.signature_map(fmts).filter("signature != 0").groupBy("signature").agg(F.count("*").alias("n"), F.min("tag").alias("only_")).filter("n = 1").select(F.col("signature").alias("g_"), "only_")
    rows = entries.join(catalog.lookup_side(sole), entries[sig_col] == F.col("g_"), "left")
    s = F.col(sig_col)
    named = F.when(s == 0, None).when(s == catalog.magic(b"OggS"), "OGG").when(s == catalog.magic(b"RIFF"), "WAV").when(s.bitwiseAND(0xFFFF) == catalog.magic(b"BM"), "BMP").otherwise(F.col("only_"))
    return rows.withColumn("detected", named).drop("g_", "only_")


def change_type(entries: DataFrame, fmts: DataFrame, tag_col: str = "detected", name_col: str = "name") -> DataFrame:
    """entries with the detected format's type and first extension."""
    firsts = catalog.lookup_side(fmts.select(F.col("tag").alias("t_"), F.col("type").alias("new_type"), F.get("extensions", F.lit(0)).alias("first_")))
    rows = entries.join(firsts, entries[tag_col] == F.col("t_"), "left")
    renamed = F.when(F.col("first_").isNotNull(), paths.change_extension(F.col(name_col), F.col("first_"))).otherwise(F.col(name_col))
    return rows.withColumn("new_name", renamed).drop("t_", "first_")


def lookup_game(files: DataFrame, games: DataFrame, pattern: str = "*.exe", key: str = "path", ord_col: str = "ord") -> DataFrame:
    """key, title: by the archive's own file name, else by the first sibling that matches the mask."""
    titles = catalog.lookup_side(games.select(F.lower("file_name").alias("f_"), "title"))
    own = files.select(key, paths.directory(F.col(key)).alias("d_"), F.lower(paths.file_name(F.col(key))).alias("n_"), F.col(ord_col).alias("o_"))
    named = own.join(titles, own.n_ == F.col("f_"), "left").select(key, "d_", F.col("title").alias("own_title"))
    sibs = own.filter(paths.matches(F.col("n_"), pattern)).join(titles, own.n_ == F.col("f_")).groupBy("d_").agg(F.min_by("title", "o_").alias("sib_title"))
    return named.join(sibs, "d_", "left").select(key, F.coalesce("own_title", "sib_title").alias("title"))
