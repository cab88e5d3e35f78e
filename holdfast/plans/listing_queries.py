"""Listing, path, dispatch and layout queries.

`documents` rows act as members of the container `source`; `pages.url` as
paths; `conversations` as consecutive chunks; `region`/`nation`/`customer` as a
tree.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast import catalog
from holdfast.operators import dispatch, layout, paths
from holdfast.plans.registry import query, table

MEMBERS = "SELECT doc_id, source, lang, n_chars, lang || '/' || source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.png' WHEN 2 THEN '.OGG' ELSE '' END AS name FROM documents"


def members(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    ext = F.when(F.col("doc_id") % 4 == 0, ".txt").when(F.col("doc_id") % 4 == 1, ".png").when(F.col("doc_id") % 4 == 2, ".OGG").otherwise("")
    return docs.withColumn("name", F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", ext))


URL_PATHS = "SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/$', '') AS name FROM pages"


def url_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", "://([^?#]*)", 1), "/$", "").alias("name"))


@query("""SELECT source AS container, lang || '/' || doc_id || '.txt' AS name,
 CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS member_offset,
 n_chars AS member_size FROM documents""")
def list_by_offset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    placed = layout.prefix_offsets(docs, ["source"], ["doc_id"], "n_chars", "member_offset")
    return placed.select(F.col("source").alias("container"), F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("name"), "member_offset", F.col("n_chars").alias("member_size")).orderBy("container", "member_offset", "name")


OFFSETS = "SELECT doc_id, source, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, CAST(sum(n_chars) OVER (PARTITION BY source) AS BIGINT) AS eof FROM documents"


def offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    eof = F.sum("n_chars").over(Window.partitionBy("source")).cast("bigint")
    return layout.prefix_offsets(docs, ["source"], ["doc_id"], "n_chars", "off").withColumn("eof", eof).drop("n_chars")


@query(f"SELECT doc_id, source, off, CAST(lead(off, 1, eof) OVER (PARTITION BY source ORDER BY doc_id) - off AS BIGINT) AS member_size FROM ({OFFSETS})")
def lead_size(spark, sf_dir):
    return layout.lead_size(offsets(spark, sf_dir), ["source"], ["doc_id"], "off", "eof", "member_size").drop("eof")


STEPS = "SELECT doc_id, source, CAST(doc_id // 60 * 100 AS BIGINT) AS off, CAST(1000000000 AS BIGINT) AS eof FROM documents"


def steps(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.expr("doc_id div 60 * 100").cast("bigint").alias("off"), F.lit(1_000_000_000).cast("bigint").alias("eof"))


@query(f"SELECT doc_id, source, off, CAST(coalesce(min(off) OVER (PARTITION BY source ORDER BY off RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), eof) - off AS BIGINT) AS member_size FROM ({STEPS})")
def strict_lead_size(spark, sf_dir):
    return layout.strict_lead_size(steps(spark, sf_dir), ["source"], "off", "eof", "member_size").drop("eof")


@query(f"""WITH s AS ({STEPS}), d AS (SELECT source, off, max(doc_id) AS last_id, min(eof) AS eof FROM s GROUP BY 1, 2),
 z AS (SELECT source, off, last_id, lead(off, 1, eof) OVER (PARTITION BY source ORDER BY off) - off AS n FROM d)
 SELECT s.doc_id, s.source, s.off, CAST(CASE WHEN s.doc_id = z.last_id THEN z.n ELSE 0 END AS BIGINT) AS member_size FROM s JOIN z USING (source, off)""")
def distinct_lead_size(spark, sf_dir):
    return layout.distinct_lead_size(steps(spark, sf_dir), ["source"], "doc_id", "off", "eof", "member_size").drop("eof")


@query("SELECT doc_id, source, n_chars, CAST(coalesce(sum((n_chars + 15) // 16 * 16) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM documents")
def aligned_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return layout.prefix_offsets(docs, ["source"], ["doc_id"], "n_chars", "off", 16)


@query("""SELECT o_custkey AS bundle, o_orderkey AS segment, CAST(coalesce(sum(o_orderkey % 100) OVER w, 0) AS BIGINT) AS packed_at,
 CAST(coalesce(sum(o_orderkey % 100 * 3) OVER w, 0) AS BIGINT) AS unpacked_at FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def segment_offsets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").alias("segment"), (F.col("o_orderkey") % 100).alias("p"), (F.col("o_orderkey") % 100 * 3).alias("u"))
    o = layout.prefix_offsets(o, ["bundle"], ["segment"], "p", "packed_at")
    return layout.prefix_offsets(o, ["bundle"], ["segment"], "u", "unpacked_at").drop("p", "u")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_id % 5 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS key_frame FROM events")
def fill_last_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 5 == 0, F.col("event_id")).alias("k"))
    return layout.fill_last(e, ["user_id"], ["ts", "event_id"], "k", "key_frame").select("user_id", "event_id", "key_frame")


@query("""WITH g AS (SELECT conv_id, length(text) AS n, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS group_no FROM conversations)
 SELECT conv_id, group_no, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS total_size FROM g GROUP BY 1, 2""")
def sessionize_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    g = layout.sessionize(c, ["conv_id"], ["turn"], F.col("role") == "user")
    return g.groupBy("conv_id", "group_no").agg(F.count("*").alias("blocks"), F.sum("n").alias("total_size"))


@query("SELECT source, n, name FROM (SELECT source, doc_id AS n, CASE WHEN doc_id % 2 = 0 THEN lower(lang) ELSE upper(lang) END AS name, row_number() OVER (PARTITION BY source, lower(lang) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_first_ci(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("n"), F.when(F.col("doc_id") % 2 == 0, F.lower("lang")).otherwise(F.upper("lang")).alias("name"))
    return paths.dedupe_first(d, ["source"], "name", "n")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https.*/EN/.7.*$', 'is')")
def glob_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.filter(paths.matches(F.col("url"), "https*/EN/?7*"))


@query(f"SELECT name FROM ({MEMBERS}) WHERE lower(name) LIKE 'en/src1/%' AND regexp_matches(regexp_extract(name, '([^/]*)$', 1), '^.*(\\..*)?$', 'is') AND name LIKE '%'")
def glob_in_directory(spark, sf_dir):
    return paths.files_in(members(spark, sf_dir).select("name"), "EN/src1/*.*")


@query(f"SELECT name FROM ({MEMBERS}) WHERE starts_with(lower(name), 'fr/src2/')")
def prefix_recursive(spark, sf_dir):
    return paths.subtree(members(spark, sf_dir).select("name"), "FR/src2")


@query(f"""WITH m AS (SELECT name, doc_id AS ord FROM ({MEMBERS}) WHERE lower(name) LIKE 'en/%'), r AS (SELECT substr(name, 4) AS rest, ord FROM m)
 SELECT arg_min(split_part(rest, '/', 1), ord) AS name, 'directory' AS kind, min(ord) AS ord FROM r WHERE contains(rest, '/') GROUP BY lower(split_part(rest, '/', 1))
 UNION ALL SELECT rest, 'file', ord FROM r WHERE NOT contains(rest, '/')""")
def children_of_dir(spark, sf_dir):
    return paths.children(members(spark, sf_dir).select("name", F.col("doc_id").alias("ord")), "en")


@query(f"""WITH m AS (SELECT name FROM ({MEMBERS})) SELECT name FROM m WHERE lower(name) = 'de/src0/0.txt' UNION ALL SELECT name FROM m WHERE name = (SELECT min(name) FROM m)
 UNION ALL SELECT name FROM m WHERE starts_with(lower(name), 'es/src3/') UNION ALL SELECT name FROM m WHERE starts_with(lower(name), 'es/')""")
def expand_selection(spark, sf_dir):
    m = members(spark, sf_dir).select("name")
    first = m.agg(F.min("name").alias("name")).withColumn("is_dir", F.lit(False))
    picked = spark.createDataFrame([("DE/src0/0.txt", False), ("es/src3", True), ("ES", True), ("..", True)], "name string, is_dir boolean")
    return paths.expand_selection(first.unionByName(picked), m)


@query(f"""WITH m AS (SELECT name, doc_id AS ord FROM ({MEMBERS})), w(wanted) AS (VALUES ('en/src4/4.txt'), ('src4/4.txt'), ('FR/SRC1/'), ('none.bin')),
 t AS (SELECT wanted, m.name AS found, 1 AS how, ord FROM w JOIN m ON lower(m.name) = lower(wanted)
  UNION ALL SELECT wanted, m.name, 2, ord FROM w JOIN m ON lower(m.name) = lower('en/' || wanted)
  UNION ALL SELECT wanted, m.name, 3, ord FROM w JOIN m ON starts_with(lower(m.name), rtrim(wanted, '/') || '/')),
 b AS (SELECT wanted, found, how, row_number() OVER (PARTITION BY wanted ORDER BY how, ord) AS rn FROM t)
 SELECT w.wanted, b.found, b.how FROM w LEFT JOIN b ON w.wanted = b.wanted AND rn = 1""")
def find_file(spark, sf_dir):
    names = spark.createDataFrame([("en/src4/4.txt",), ("src4/4.txt",), ("FR/SRC1/",), ("none.bin",)], "wanted string")
    return paths.find(names, members(spark, sf_dir).select("name", F.col("doc_id").alias("ord")), "en")


@query(f"SELECT page_id, name, regexp_extract(name, '([^\\\\/:]*)$', 1) AS file_name, lower(regexp_extract(name, '\\.([^.\\\\/:]*)$', 1)) AS ext, regexp_extract(name, '^(.*)[\\\\/:][^\\\\/:]*$', 1) AS dir, lower(regexp_extract(name, '\\.([^.\\\\/:]*)$', 1)) IN ('html', 'htm') AS is_html FROM ({URL_PATHS})")
def path_parts(spark, sf_dir):
    u = url_paths(spark, sf_dir)
    n = F.col("name")
    return u.select("page_id", "name", paths.file_name(n).alias("file_name"), paths.extension(n).alias("ext"), paths.directory(n).alias("dir"), paths.has_extension(n, ".HTML", "htm").alias("is_html"))


@query("SELECT p_partkey, 'a/' || p_size || '/' || p_brand AS target FROM part")
def chdir_normalise(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", paths.normalise(F.concat(F.lit("C:\\a/b/.././x//.."), F.lit("/"), "p_size", F.lit("\\"), "p_brand")).alias("target"))


@query(f"SELECT DISTINCT '*.' || lower(regexp_extract(name, '\\.([^./]*)$', 1)) AS mask FROM ({MEMBERS}) WHERE regexp_matches(name, '\\.[^./]+$')")
def distinct_extensions(spark, sf_dir):
    return paths.masks(members(spark, sf_dir))


@query(f"""WITH m AS (SELECT name FROM ({MEMBERS})), s AS (SELECT name FROM m WHERE starts_with(name, 'en/src1/'))
 SELECT name, 0 AS added FROM s UNION ALL SELECT name, 1 FROM m WHERE regexp_matches(name, '^.*\\.txt$', 'is') AND name NOT IN (SELECT name FROM s)""")
def selection_by_mask(spark, sf_dir):
    m = members(spark, sf_dir).select("name")
    return paths.select_by_mask(m, m.filter(F.col("name").startswith("en/src1/")), "*.TXT")


TYPES = "CASE lower(regexp_extract(name, '\\.([^./]*)$', 1)) WHEN 'txt' THEN 'script' WHEN 'png' THEN 'image' WHEN 'ogg' THEN 'audio' ELSE '' END"


@query(f"SELECT doc_id, name, {TYPES} AS type FROM ({MEMBERS})")
def type_from_ext(spark, sf_dir):
    return dispatch.type_of_name(members(spark, sf_dir).select("doc_id", "name"), catalog.formats(spark), catalog.aliases(spark))


def driver_formats(spark):
    rows = [("part" + str(i), "", ("image", "archive", "audio", "script")[i % 4], [0] if i % 3 == 0 else [i % 7, 0] if i % 3 == 1 else [i % 7], ["e" + str(i % 5)], False, i % 4, False, []) for i in range(30)]
    return spark.createDataFrame(rows, catalog.FORMATS_SCHEMA)


@query("""WITH f AS (SELECT i, 'part' || i AS tag, i % 4 AS kind_no, 'e' || (i % 5) AS ext, i % 4 AS priority,
   CASE i % 3 WHEN 0 THEN [0] WHEN 1 THEN [i % 7, 0] ELSE [i % 7] END AS sigs FROM range(30) t(i)),
 x AS (SELECT c_custkey AS path, c_custkey % 7 AS sig, 'e' || (c_custkey % 6) AS ext, 'part' || (c_custkey % 30) AS pref FROM customer),
 m AS (SELECT path, tag, kind_no, priority, min(CASE WHEN s = x.sig THEN 1 ELSE 2 END) AS pass_no, bool_or(tag = pref) AS liked, bool_or(f.ext = x.ext) AS by_ext
   FROM x, f, unnest(f.sigs) u(s) WHERE s = x.sig OR s = 0 GROUP BY ALL)
 SELECT path, tag, CAST(pass_no AS INT) AS pass_no, CAST(row_number() OVER (PARTITION BY path ORDER BY pass_no, liked DESC, by_ext DESC, kind_no, priority DESC, tag) AS INT) AS rank FROM m""")
def dispatch_rank(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    files = c.select(F.col("c_custkey").alias("path"), (F.col("c_custkey") % 7).alias("signature"), F.concat(F.lit("e"), F.col("c_custkey") % 6).alias("extension"), F.array(F.concat(F.lit("part"), F.col("c_custkey") % 30)).alias("preferred"))
    return dispatch.candidates(files, driver_formats(spark)).select("path", "tag", "pass_no", "rank")


@query("""WITH e AS (SELECT p_partkey AS id, p_name || '.dat' AS name, CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1399285583 WHEN 2 THEN 1179011410 WHEN 3 THEN 305419896 WHEN 4 THEN 1196314761 WHEN 5 THEN 19778 + 65536 * (p_partkey % 100) ELSE 944130375 END AS signature FROM part),
 d AS (SELECT *, CASE p WHEN 1 THEN 'OGG' WHEN 2 THEN 'WAV' WHEN 4 THEN 'PNG' WHEN 5 THEN 'BMP' WHEN 6 THEN 'GIF' END AS detected FROM (SELECT *, id % 7 AS p FROM e))
 SELECT id, detected, CASE p WHEN 1 THEN 'audio' WHEN 2 THEN 'audio' WHEN 4 THEN 'image' WHEN 5 THEN 'image' WHEN 6 THEN 'image' END AS new_type,
  regexp_replace(name, '\\.dat$', '') || '.' || CASE p WHEN 1 THEN 'ogg' WHEN 2 THEN 'wav' WHEN 4 THEN 'png' WHEN 5 THEN 'bmp' WHEN 6 THEN 'gif' ELSE 'dat' END AS new_name FROM d""")
def detect_and_change_type(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 7
    sig = F.when(k == 0, 0).when(k == 1, 1399285583).when(k == 2, 1179011410).when(k == 3, 305419896).when(k == 4, 1196314761).when(k == 5, 19778 + 65536 * (F.col("p_partkey") % 100)).otherwise(944130375)
    e = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(".dat")).alias("name"), sig.cast("bigint").alias("signature"))
    fmts = catalog.formats(spark)
    return dispatch.change_type(dispatch.detect_type(e, fmts), fmts).select("id", "detected", "new_type", "new_name")


@query("""WITH f AS (SELECT p_partkey AS ord, 'd' || (p_partkey % 37) || '/' || CASE WHEN p_partkey % 5 = 0 THEN 'game' || (p_partkey % 11) || '.EXE' ELSE 'a' || (p_partkey % 23) || '.arc' END AS path FROM part),
 g(file_name, title) AS (SELECT 'game' || i || '.exe', 'Title ' || i FROM range(8) t(i) UNION ALL SELECT 'A3.arc', 'Named'),
 n AS (SELECT f.ord, f.path, split_part(path, '/', 1) AS d, lower(split_part(path, '/', 2)) AS n FROM f),
 s AS (SELECT d, arg_min(title, ord) AS t FROM n JOIN g ON n.n = lower(g.file_name) WHERE n.n LIKE '%.exe' GROUP BY d)
 SELECT n.ord, n.path, coalesce(g.title, s.t) AS title FROM n LEFT JOIN g ON n.n = lower(g.file_name) LEFT JOIN s ON n.d = s.d""")
def lookup_game(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    f = p.select(k.alias("ord"), F.concat(F.lit("d"), k % 37, F.lit("/"), F.when(k % 5 == 0, F.concat(F.lit("game"), k % 11, F.lit(".EXE"))).otherwise(F.concat(F.lit("a"), k % 23, F.lit(".arc")))).alias("path"))
    games = spark.createDataFrame([(f"game{i}.exe", f"Title {i}") for i in range(8)] + [("A3.arc", "Named")], "file_name string, title string")
    return dispatch.lookup_game(f.withColumn("key", F.concat_ws("|", "ord", "path")).drop("path").withColumnRenamed("key", "path").withColumn("path", F.substring_index("path", "|", -1)), games).join(f.distinct(), "path").select("ord", "path", "title").distinct()


@query(f"""WITH m AS (SELECT doc_id, name, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE doc_id * 10 END AS off, {TYPES} AS type FROM ({MEMBERS}))
 SELECT doc_id, name, off, type FROM m WHERE off >= 0 AND ((SELECT count(*) FROM m) < 2 OR type <> 'script')""")
def offset_type_filter(spark, sf_dir):
    m = dispatch.type_of_name(members(spark, sf_dir).select("doc_id", "name"), catalog.formats(spark), catalog.aliases(spark))
    m = m.withColumn("off", F.when(F.col("doc_id") % 9 == 0, -1).otherwise(F.col("doc_id") * 10).cast("bigint"))
    single = m.limit(2).agg((F.count("*") < 2).alias("single")).scalar()
    return m.filter(F.col("off") >= 0).filter(single | (F.col("type") != "script"))


@query(f"SELECT name, type, n_chars, type IN ('image', 'audio') AS converts, (type IN ('image', 'script') OR (type = '' AND n_chars < 1048576)) AS previews FROM (SELECT *, {TYPES} AS type FROM ({MEMBERS}))")
def convert_and_preview(spark, sf_dir):
    m = dispatch.type_of_name(members(spark, sf_dir).select("name", "n_chars"), catalog.formats(spark), catalog.aliases(spark))
    t = F.col("type")
    return m.select("name", "type", "n_chars", t.isin("image", "audio").alias("converts"), (t.isin("image", "script") | ((t == "") & (F.col("n_chars") < 0x100000))).alias("previews"))


@query(f"""WITH m AS (SELECT name, CASE WHEN doc_id % 10 = 3 THEN 'directory' ELSE {TYPES} END AS type, n_chars FROM ({MEMBERS}))
 SELECT name, type, CAST(row_number() OVER (ORDER BY CASE type WHEN 'directory' THEN -1 ELSE 0 END, CASE WHEN type = '' THEN 1 ELSE 0 END, type, lower(name)) AS INT) AS place FROM m""")
def sort_view(spark, sf_dir):
    # the browser's view of one listing: at most MAX_MEMBERS rows, ordered by one sort
    m = dispatch.type_of_name(members(spark, sf_dir).select("doc_id", "name"), catalog.formats(spark), catalog.aliases(spark))
    m = m.withColumn("type", F.when(F.col("doc_id") % 10 == 3, "directory").otherwise(F.col("type")))
    w = Window.orderBy(F.when(F.col("type") == "directory", -1).otherwise(0), (F.col("type") == "").cast("int"), "type", F.lower("name"))
    return m.select("name", "type", F.row_number().over(w).alias("place"))


@query("""SELECT event_type AS file_name, CAST(max(epoch_us(ts) // 1000) AS BIGINT) AS last_ms, count(*) AS uses FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 9""")
def mru_topk(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp_ltz"))
    return e.groupBy(F.col("event_type").alias("file_name")).agg(F.max(ms).alias("last_ms"), F.count("*").alias("uses")).orderBy(F.desc("last_ms"), "file_name").limit(9)


@query("""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region
   UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
 t AS (SELECT id, name AS path, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.path || '/' || n.name, t.depth + 1 FROM n JOIN t ON n.parent = t.id)
 SELECT id, path, CAST(depth AS INT) AS depth FROM t""")
def tree_paths(spark, sf_dir):
    none = F.lit(None).cast("string")
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), none.alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return layout.tree_paths(spark, r.unionByName(n).unionByName(c))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey < 30000 AND l_partkey <= 30000 AND l_orderkey <= 30000 - l_partkey) AS placed, (l_linenumber > 0 AND l_linenumber < 262144) AS sane FROM lineitem")
def placement_check(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", layout.is_placed(F.col("l_orderkey"), F.col("l_partkey"), F.lit(30000)).alias("placed"), layout.is_sane_count(F.col("l_linenumber")).alias("sane"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '/' || p_name WHEN 2 THEN 'c:' || p_name ELSE p_name END AS name, p_partkey % 4 = 3 AS valid FROM part")
def valid_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, " ").when(k == 1, F.concat(F.lit("/"), "p_name")).when(k == 2, F.concat(F.lit("c:"), "p_name")).otherwise(F.col("p_name")).alias("name"))
    return p.withColumn("valid", paths.is_valid_name(F.col("name")))


@query("SELECT source, doc_id, printf('%05d', row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS name FROM documents")
def numbered_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return layout.number_rows(d, ["source"], ["doc_id"], "%05d")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END || '.txt' AS name FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY doc_id) - 1 AS n FROM d)
 SELECT doc_id, name, CASE WHEN n = 0 THEN name WHEN n <= 100 THEN replace(name, '.txt', '') || '.' || n || '.txt' END AS target FROM r""")
def rename_policy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit(".txt")).alias("name"))
    return paths.rename_duplicates(d, "name", "doc_id")


@query(f"SELECT source, string_agg(name, chr(13) || chr(10) ORDER BY doc_id) AS clip FROM ({MEMBERS}) GROUP BY source")
def copy_names(spark, sf_dir):
    m = members(spark, sf_dir)
    return m.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "name"))), lambda x: x.getField("name")), "\r\n").alias("clip"))
