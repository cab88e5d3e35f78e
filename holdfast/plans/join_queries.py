"""Join, aggregation, set and sort patterns of index tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.operators import layout, paths
from holdfast.plans.listing_queries import MEMBERS, members
from holdfast.plans.registry import query, table


@query("SELECT o_orderkey, coalesce(c_name, 'file' || o_custkey) AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def left_name_lookup(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("file"), "o_custkey")).alias("name"))


@query("""WITH a AS (SELECT doc_id AS id, lang || doc_id AS name, n_chars AS size FROM documents WHERE doc_id % 3 > 0), b AS (SELECT DISTINCT doc_id AS id, CAST(quality * 100 + toxic AS BIGINT) AS isize FROM labels)
 SELECT id, name, coalesce(isize, size) AS size FROM a FULL JOIN b USING (id)""")
def full_outer_merge(spark, sf_dir):
    a = table(spark, sf_dir, "documents").filter("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), F.concat("lang", "doc_id").alias("name"), F.col("n_chars").alias("size"))
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 100 + F.col("toxic")).cast("bigint").alias("isize")).distinct()
    return layout.merge_full(a, b, "id", {"size": "isize"}).select("id", "name", "size")


@query("""SELECT c_custkey AS cast_id, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'O') AS o, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS f, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'P') AS p
 FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def cast_members(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    rows = c.join(o, c.c_custkey == o.o_custkey)
    got = layout.first_per_kind(rows, ["c_custkey"], "o_orderstatus", ["O", "F", "P"], "o_orderkey", "o_orderkey")
    return got.select(F.col("c_custkey").alias("cast_id"), F.col("O").alias("o"), F.col("F").alias("f"), F.col("P").alias("p"))


@query("""WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents), b AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS pos FROM documents)
 SELECT source, CAST(pos AS INT) AS pos, doc_id, n_chars FROM a JOIN b USING (source, pos)""")
def positional_zip(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = d.select("source", "doc_id"), d.select("source", "n_chars", F.col("doc_id").alias("k"))
    return layout.zip_by_ordinal(a, b, ["source"], ["doc_id"], ["n_chars", "k"]).select("source", "pos", "doc_id", "n_chars")


@query(f"""WITH m AS (SELECT doc_id, regexp_replace(name, '\\.[^./]*$', '') AS stem, lower(regexp_extract(name, '\\.([^./]*)$', 1)) AS ext FROM ({MEMBERS})),
 s AS (SELECT doc_id, stem, ext FROM m UNION ALL SELECT doc_id + 1000000, stem, 'idx' FROM m WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id + 2000000, stem, 'toc' FROM m WHERE doc_id % 4 = 0)
 SELECT m.doc_id, arg_min(s.doc_id, CASE s.ext WHEN 'toc' THEN 1 ELSE 2 END) AS index_id, arg_min(s.ext, CASE s.ext WHEN 'toc' THEN 1 ELSE 2 END) AS index_ext FROM m JOIN s ON m.stem = s.stem AND s.ext IN ('toc', 'idx') GROUP BY m.doc_id""")
def sidecar_lookup(spark, sf_dir):
    m = members(spark, sf_dir).select("doc_id", F.regexp_replace("name", r"\.[^./]*$", "").alias("stem"))
    side = m.filter("doc_id % 6 = 0").select((F.col("doc_id") + 1_000_000).alias("index_id"), "stem", F.lit("idx").alias("ext"), F.lit(2).alias("r"))
    side = side.unionByName(m.filter("doc_id % 4 = 0").select((F.col("doc_id") + 2_000_000).alias("index_id"), "stem", F.lit("toc").alias("ext"), F.lit(1).alias("r")))
    best = m.join(side, "stem").groupBy("doc_id").agg(F.min_by(F.struct("index_id", "ext"), "r").alias("b"))
    return best.select("doc_id", F.col("b.index_id").alias("index_id"), F.col("b.ext").alias("index_ext"))


@query("""WITH a AS (SELECT c_custkey % 97 AS archive, count(*) AS length FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), n AS (SELECT length, min(archive) AS archive FROM a GROUP BY 1)
 SELECT p_partkey, archive FROM part JOIN n ON p_size * 3 = length""")
def master_index(spark, sf_dir):
    o, c, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    a = o.join(c, o.o_custkey == c.c_custkey).groupBy((F.col("c_custkey") % 97).alias("archive")).agg(F.count("*").alias("length"))
    n = a.groupBy("length").agg(F.min("archive").alias("archive"))
    return p.join(n, F.col("p_size") * 3 == F.col("length")).select("p_partkey", "archive")


@query("""WITH x AS (SELECT o_orderkey AS id, o_custkey AS stem, o_orderpriority AS bpp FROM orders)
 SELECT a.id, min(b.id) AS base FROM x a JOIN x b ON a.stem = b.stem AND a.bpp = b.bpp AND a.id <> b.id GROUP BY a.id""")
def theta_base_lookup(spark, sf_dir):
    # the first other file of the same stem and depth: the least, or for the least itself the second
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("stem"), F.col("o_orderpriority").alias("bpp"))
    two = x.groupBy("stem", "bpp").agg(F.min("id").alias("lo"))
    second = x.join(two, ["stem", "bpp"]).filter("id > lo").groupBy("stem", "bpp").agg(F.min("id").alias("second"))
    met = x.join(two, ["stem", "bpp"]).join(second, ["stem", "bpp"])
    return met.select("id", F.when(F.col("id") == F.col("lo"), F.col("second")).otherwise(F.col("lo")).alias("base"))


PARTS = "SELECT o_custkey AS c, o_orderkey AS part, o_orderkey AS s, o_orderkey + 40 AS e FROM orders"


@query(f"SELECT l.l_orderkey, l.l_linenumber, p.part, least(l.l_orderkey * 1 + l.l_linenumber * 9, p.e) - greatest(l.l_orderkey, p.s) AS taken FROM lineitem l JOIN ({PARTS}) p ON l.l_suppkey % 100 = p.c % 100 AND l.l_orderkey < p.e AND p.s < l.l_orderkey + l.l_linenumber * 9")
def interval_overlap(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 100).alias("k"), F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_linenumber") * 9).alias("b"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("part"), (F.col("o_custkey") % 100).alias("k"), F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + 40).alias("e"))
    met = layout.overlap_join(l, p, ["k"], ("a", "b"), ("s", "e"), 128)
    return met.select("l_orderkey", "l_linenumber", "part", (F.least("b", "e") - F.greatest("a", "s")).alias("taken"))


@query("SELECT c_custkey, (c_custkey * 37) % 5000 AS at, s_suppkey AS segment FROM customer JOIN supplier ON (c_custkey * 37) % 5000 >= s_suppkey * 60 AND (c_custkey * 37) % 5000 < s_suppkey * 60 + 45")
def interval_containment(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37) % 5000).alias("at"), F.lit(0).alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("segment"), (F.col("s_suppkey") * 60).alias("s"), (F.col("s_suppkey") * 60 + 45).alias("e"), F.lit(0).alias("k"))
    return layout.contain_join(c, s, ["k"], "at", ("s", "e"), 64).select("c_custkey", "at", "segment")


@query("WITH f AS (SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT substr(p_type, 1, 4) FROM part) SELECT p_partkey, f.p_type AS layer FROM part p JOIN f ON starts_with(p.p_type, f.p_type)")
def prefix_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_type").alias("layer")).unionByName(p.select(F.substring("p_type", 1, 4).alias("layer"))).distinct()
    return layout.prefix_join(p.select("p_partkey", "p_type"), f, "p_type", "layer").select("p_partkey", "layer")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS seen FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def existence(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    left = c.join(o.filter("o_orderstatus = 'F'"), "c_custkey", "left_anti")
    hit = o.filter("o_orderstatus = 'O'").select("c_custkey", F.lit(True).alias("seen")).distinct()
    return left.join(hit, "c_custkey", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


@query("""SELECT s_nationkey AS version FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus AS item FROM lineitem) ON s_suppkey = l_suppkey GROUP BY 1
 HAVING count(DISTINCT item) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)""")
def relational_division(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("item"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("version"))
    return layout.divide(l.join(s, l.l_suppkey == s.s_suppkey), "version", "item", l)


@query("""SELECT e.event_id, k.event_id AS key_event FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) k ON e.user_id = k.user_id AND e.ts >= k.ts""")
def as_of_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    k = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("key_event"))
    return layout.as_of_join(e.select("event_id", "user_id", "ts"), k, ["user_id"], "ts", "ts", "key_event", "found").select("event_id", F.col("found").alias("key_event"))


@query(f"""SELECT source, count(*) AS members, count(*) >= 2 AS several, CAST(sum(n_chars) AS BIGINT) AS total_size, max(length(name)) AS longest, bool_and(regexp_matches(CAST(doc_id AS VARCHAR), '^[0-9]+$')) AS all_digits FROM ({MEMBERS}) GROUP BY source""")
def listing_totals(spark, sf_dir):
    m = members(spark, sf_dir)
    return m.groupBy("source").agg(F.count("*").alias("members"), (F.count("*") >= 2).alias("several"), F.sum("n_chars").alias("total_size"), F.max(F.length("name")).cast("bigint").alias("longest"), F.bool_and(F.col("doc_id").cast("string").rlike("^[0-9]+$")).alias("all_digits"))


@query(f"""WITH g AS (SELECT source, lower(regexp_extract(name, '\\.([^./]*)$', 1)) AS ext, count(*) AS files FROM ({MEMBERS}) GROUP BY 1, 2)
 SELECT source, ext, files, CAST(count(*) OVER (PARTITION BY source) * 12 + coalesce(sum(files) OVER (PARTITION BY source ORDER BY ext ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 17 AS BIGINT) AS list_offset FROM g""")
def group_by_extension(spark, sf_dir):
    m = members(spark, sf_dir).withColumn("ext", paths.extension(F.col("name")))
    return layout.group_directories(m, ["source"], "ext", "ext", 17, 12)


@query("SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang")
def multimap(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("SELECT r_name, n_name FROM (SELECT r_name, unnest(list(n_name)) AS n_name FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name)")
def flatten_schemes(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.join(n, r.r_regionkey == n.n_regionkey).groupBy("r_name").agg(F.collect_list("n_name").alias("ns")).select("r_name", F.explode("ns").alias("n_name"))


@query(f"SELECT source, name, CAST(row_number() OVER (PARTITION BY source ORDER BY md5(lower(name)), name) AS INT) AS place FROM ({MEMBERS})")
def sort_by_name_hash(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.md5(F.lower("name")), "name")
    return members(spark, sf_dir).select("source", "name", F.row_number().over(w).alias("place"))


@query("SELECT n_regionkey, arg_max(n_name, n_nationkey) AS newest, min(n_nationkey) AS first_key, max(n_nationkey) AS last_key FROM nation WHERE n_nationkey % 4 > 0 GROUP BY 1")
def newest_compatible(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 4 > 0")
    return n.groupBy("n_regionkey").agg(F.max_by("n_name", "n_nationkey").alias("newest"), F.min("n_nationkey").alias("first_key"), F.max("n_nationkey").alias("last_key"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10")
def skip_take(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").offset(10).limit(25)


@query("SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '/') AS stack FROM pages")
def reverse_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), "[.]")), "/").alias("stack"))


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation")
def union_all(spark, sf_dir):
    c, s, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return c.select(F.col("c_name").alias("name")).unionByName(s.select(F.col("s_name").alias("name"))).unionByName(n.select(F.col("n_name").alias("name")))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def subtract_set(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT r_regionkey, CAST(i AS INT) AS i, repeat('x', CAST(i AS INT)) AS bar FROM region, unnest(range(0, 10)) t(i)")
def range_generators(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    return r.withColumn("bar", F.array_join(F.array_repeat(F.lit("x"), F.col("i")), ""))


@query("""WITH b AS (SELECT p_partkey AS id, p_size AS x, p_partkey % 50 AS y, 10 AS w, 20 AS h FROM part), f AS (SELECT *, 5 + p % 7 AS fx, 3 AS fy, 30 AS fw, 25 AS fh FROM (SELECT *, id % 13 AS p FROM b))
 SELECT id, least(x, fx) AS left_, least(y, fy) AS top, greatest(x + w, fx + fw) - least(x, fx) AS width, (x < fx + fw AND fx < x + w AND y < fy + fh AND fy < y + h) AS meets FROM f""")
def box_union(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("x"), (F.col("p_partkey") % 50).alias("y"), (F.lit(5) + F.col("p_partkey") % 13 % 7).alias("fx"))
    x, y, fx = F.col("x"), F.col("y"), F.col("fx")
    return p.select("id", F.least(x, fx).alias("left_"), F.least(y, F.lit(3)).alias("top"), (F.greatest(x + 10, fx + 30) - F.least(x, fx)).alias("width"), ((x < fx + 30) & (fx < x + 10) & (y < 28) & (y + 20 > 3)).alias("meets"))


@query("SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1")
def first_wins(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'image' WHEN 'Brand#2' THEN 'audio' WHEN 'Brand#3' THEN 'script' END AS type FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def class_filter(spark, sf_dir):
    kinds = spark.createDataFrame([("Brand#1", "image"), ("Brand#2", "audio"), ("Brand#3", "script")], "p_brand string, type string")
    return table(spark, sf_dir, "part").join(F.broadcast(kinds), "p_brand").select("p_partkey", "type")
