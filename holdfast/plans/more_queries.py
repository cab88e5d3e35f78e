"""Further listing patterns: overrides, completion, sequence tests, parent pointers, record reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdfast import catalog
from holdfast.functions import bytesfn as bf
from holdfast.functions import structs
from holdfast.operators import dispatch, paths
from holdfast.plans.listing_queries import MEMBERS, TYPES, members
from holdfast.plans.registry import query, table


@query(f"SELECT name, CASE WHEN doc_id % 50 = 0 THEN 'audio' ELSE {TYPES} END AS type FROM ({MEMBERS})")
def type_override(spark, sf_dir):
    m = dispatch.type_of_name(members(spark, sf_dir).select("doc_id", "name"), catalog.formats(spark), catalog.aliases(spark))
    chosen = m.filter("doc_id % 50 = 0").select(F.col("name").alias("n_"), F.lit("audio").alias("new_"))
    return m.join(chosen, m.name == F.col("n_"), "left").select("name", F.coalesce("new_", "type").alias("type"))


@query(f"SELECT name FROM ({MEMBERS}) WHERE starts_with(lower(name), 'de/') ORDER BY lower(name) LIMIT 1")
def type_ahead(spark, sf_dir):
    m = members(spark, sf_dir).select("name")
    return m.filter(F.lower("name").startswith("de/")).orderBy(F.lower("name")).limit(1)


@query(f"SELECT DISTINCT regexp_extract(name, '^(.*)/[^/]*$', 1) AS dir FROM ({MEMBERS}) WHERE starts_with(lower(regexp_extract(name, '^(.*)/[^/]*$', 1)), 'fr/src1')")
def path_completion(spark, sf_dir):
    d = members(spark, sf_dir).select(paths.directory(F.col("name")).alias("dir"))
    return d.filter(F.lower("dir").startswith("fr/src1")).distinct()


@query("SELECT p_partkey, string_split(p_type, ' ')[1:2] = string_split(p_type || ' x', ' ')[1:2] AS same_head, encode(p_brand) = encode('Brand#1') AS same_bytes FROM part")
def sequence_equality(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    head = lambda c: F.slice(F.split(c, " "), 1, 2)
    return p.select("p_partkey", (head(F.col("p_type")) == head(F.concat("p_type", F.lit(" x")))).alias("same_head"), (F.encode("p_brand", "UTF-8") == F.lit(b"Brand#1")).alias("same_bytes"))


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 3 THEN p_partkey // 3 END AS parent FROM part),
 t AS (SELECT id, CAST(id AS VARCHAR) AS path, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.path || '/' || n.id, t.depth + 1 FROM n JOIN t ON n.parent = t.id)
 SELECT id, path, CAST(depth AS INT) AS depth FROM t""")
def parent_pointers(spark, sf_dir):
    from holdfast.operators import layout

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 3, F.expr("p_partkey div 3")).alias("parent"), F.col("p_partkey").cast("string").alias("name"))
    return layout.tree_paths(spark, p)


RECORD = [("magic", "text:4"), ("key", "u32"), ("box", [("size", "i32"), ("flags", "u16>")]), ("name", "text:12")]


@query("SELECT p_partkey, 'REC' AS magic, p_partkey AS key, CAST(-p_size AS BIGINT) AS size, CAST(513 AS BIGINT) AS flags, substr(p_brand, 1, 12) AS name FROM part")
def record_struct(spark, sf_dir):
    """Records packed as columns, read by their layout."""
    field = lambda c, n: F.rpad(F.encode(F.substring(c, 1, n), "UTF-8"), n, F.lit(b"\0"))
    b = F.concat(F.lit(b"REC\0"), bf.pack_le(F.col("p_partkey"), 4), bf.pack_le(-F.col("p_size"), 4), F.lit(b"\2\1"), field("p_brand", 12))
    r = table(spark, sf_dir, "part").select("p_partkey", structs.read_struct(b, 0, RECORD).alias("r"))
    return r.select("p_partkey", "r.magic", "r.key", F.col("r.box.size").alias("size"), F.col("r.box.flags").alias("flags"), "r.name")


@query("SELECT 'x' || (c_custkey % 40) AS extension, count(*) AS files, CASE WHEN c_custkey % 40 < 30 THEN 'part' || (c_custkey % 40) END AS tag FROM customer GROUP BY c_custkey % 40")
def lookup_extension(spark, sf_dir):
    """Files by extension with the tag that claims it, if one does."""
    rows = [("part" + str(i), "", "image", [0], ["x" + str(i)], False, 0, False, []) for i in range(30)]
    ext = catalog.extension_map(spark.createDataFrame(rows, catalog.FORMATS_SCHEMA)).select("extension", "tag")
    c = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("x"), F.col("c_custkey") % 40).alias("extension")).agg(F.count("*").alias("files"))
    return c.join(catalog.lookup_side(ext), "extension", "left")
