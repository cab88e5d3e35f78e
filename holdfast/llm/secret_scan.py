"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of 20 or more characters of keys and digests, a quoted
value of eight or more after = or :, an unquoted one after a name such as
password, or a private key block, whatever its length and head lines. Each is described
by its length, its character transitions (between lower case, upper case,
digits and the rest; between vowels and consonants), the share of it that
dictionary words cover, whether it stands in a path, and the words beside it.
A random forest trained on labelled findings gives the probability that it is
a secret; below KEEP_AT it is dropped as a false positive.

The dictionary is the corpus's own: words of three to eight letters that
DICTIONARY_SHARE of all documents hold, counted over all of them; it has at
most (mean distinct words of a document) / DICTIONARY_SHARE words. Labelled
findings are the caller's (left, value, right, label), TRAIN_ROWS of them at
most, or those of labelled_findings(), made by rule: no labels come with the
corpus.

Only DataFrame functions and Spark's own forest are used. Scale: texts are read
where they lie; only texts with a candidate are exploded, equal ones once.
Candidates' substrings join the dictionary, which is broadcast up to
BROADCAST_WORDS words (counted), else by shuffle. Spans are kept by the number
of the match, so texts are rebuilt in their own row.

Defined results: null and empty texts have no findings; equal texts share their
findings, repeated rows stay; ties of the forest (probability KEEP_AT) are
secrets; with an empty corpus dictionary nothing is covered; an empty table
gives no rows; extra columns are ignored by scan and returned by redact.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import LOWER, UPPER, stage

CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?s:.+?)-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
    r"|(?<=[:=] ?[\"'])[^\s\"']{8,}+(?=[\"'])"
    r"|(?<=[:=] ?)(?<=(?i:passw|pwd|secret|token|key|auth)[A-Za-z_]{0,8}[\"']? ?[:=] ?)[^\s\"'&;,]{8,}+"
)
NEAR = 80
KEEP_AT = 0.5
TRAIN_ROWS = 20_000
DICTIONARY_SHARE = 0.005
BROADCAST_WORDS = 200_000
MASK = "[SECRET]"

GOOD_WORDS = r"(?i)(secret|token|passw|pwd|api|key|auth|bearer|credential|private)"
BAD_WORDS = r"(?i)(sha-?[0-9]|md5|checksum|hash|commit|digest|etag|uuid|guid|example|sample|dummy|integrity|revision|fingerprint|blob|base64,)"
FEATURES = ["f_length", "f_class", "f_vowel", "f_digit", "f_upper", "f_distinct", "f_covered", "f_path", "f_good", "f_bad", "f_assigned", "f_filler"]


def with_candidates(docs: DataFrame, text_col: str) -> Column:
    return F.rlike(F.coalesce(F.col(text_col), F.lit("")), F.lit(CANDIDATE))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (digest of the text), k, start, value, left, right: each match in each different text."""
    held = docs.filter(with_candidates(docs, text_col)).select(F.md5(text_col).alias("key"), F.col(text_col).alias("text"))
    held = held.groupBy("key").agg(F.first("text").alias("text"))
    parts = held.select("key", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split("text", CANDIDATE, -1).alias("pieces"))
    rows = parts.select("key", F.posexplode(F.arrays_zip(F.col("pieces"), F.col("hits"), F.slice("pieces", F.lit(2), F.size("hits")).alias("after"))).alias("k", "m"))
    rows = rows.select("key", "k", F.col("m.pieces").alias("piece"), F.col("m.hits").alias("value"), F.col("m.after").alias("after"))
    order = Window.partitionBy("key").orderBy("k")
    # a long name is a match itself and may hold the sign: what it names still has it on its left
    named = F.concat(F.when(F.rlike("piece", F.lit("^[\"']? ?[:=]? ?[\"']?$")), F.coalesce(F.lag("value").over(order), F.lit(""))).otherwise(""), "piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.length("piece") + F.coalesce(F.length("value"), F.lit(0))).over(before), F.lit(0))
    rows = rows.select("key", "k", (ahead + F.length("piece")).alias("start"), "value", F.right(named, F.lit(NEAR)).alias("left"), F.expr(f"left(after, {NEAR})").alias("right"))
    return rows.filter("value IS NOT NULL")


def dictionary(docs: DataFrame, text_col: str = "text", share: float = DICTIONARY_SHARE) -> DataFrame:
    """word: the common words of three to eight ASCII letters, over all documents."""
    n = docs.count()
    found = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"))
    counted = docs.select(F.explode(found).alias("word")).filter(F.rlike("word", F.lit("^[a-z]{3,8}$"))).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= max(2, share * n)).select("word")


def covered(findings: DataFrame, words: DataFrame) -> DataFrame:
    """value, f_covered: the share of each different value's characters that lie in a dictionary word."""
    values = findings.select("value").distinct()
    low = F.lower("value")
    starts = values.select("value", F.explode(F.sequence(F.lit(1), F.greatest(F.length("value") - 2, F.lit(1)))).alias("at"))
    pieces = starts.select("value", "at", F.explode(F.sequence(F.lit(3), F.lit(8))).alias("n")).filter("at + n - 1 <= length(value)")
    pieces = pieces.select("value", "at", "n", F.substring(low, F.col("at"), F.col("n")).alias("word"))
    small = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    met = pieces.join(F.broadcast(words) if small else words, "word")
    longest = met.groupBy("value", "at").agg(F.max("n").alias("n"))
    spread = longest.select("value", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("c")).distinct()
    return spread.groupBy("value").agg((F.count("*") / F.length("value")).alias("f_covered"))


def share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def features(findings: DataFrame, words: DataFrame) -> DataFrame:
    """findings (value, left, right, ...) with FEATURES."""
    v = F.col("value")
    kinds = F.regexp_replace(F.translate(F.translate(F.translate(v, LOWER, "a" * 26), UPPER, "A" * 26), "0123456789", "0" * 10), "[^aA0]", "-")
    sounds = F.regexp_replace(F.regexp_replace(F.lower(v), "[aeiouy]", "V"), "[^V]", "c")
    changes = lambda x: (F.length(F.regexp_replace(x, r"(.)\1+", "$1")) - 1) / F.greatest(F.length(x) - 1, F.lit(1))
    flag = lambda c: c.cast("double")
    named = findings.join(covered(findings, words), "value", "left")
    return named.withColumns(
        {
            "f_length": F.log2(F.length(v).cast("double")),
            "f_class": changes(kinds),
            "f_vowel": changes(sounds),
            "f_digit": share(v, "[^0-9]"),
            "f_upper": share(v, "[^A-Z]"),
            "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / F.length(v),
            "f_covered": F.coalesce("f_covered", F.lit(0.0)),
            "f_path": flag(F.rlike("left", F.lit(r"[/.@\\]$|://[^\s=]*$")) | F.rlike("right", F.lit(r"^(\.[A-Za-z]{1,5}\b|[/@\\])")) | F.rlike(v, F.lit(r"^/|/.*/"))),
            "f_good": flag(F.rlike("left", F.lit(GOOD_WORDS)) | F.rlike(v, F.lit("^(AKIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ|AIza|-----BEGIN)"))),
            "f_bad": flag(F.rlike("left", F.lit(BAD_WORDS)) | F.rlike("right", F.lit(BAD_WORDS))),
            "f_assigned": flag(F.rlike("left", F.lit(r"[:=]\s*[\"']?$"))),
            "f_filler": flag(F.rlike(v, F.lit(r"(?i)(xxxx|your[_-]|replace|change|example|placeholder|1234567|abcdef|(.)\2{5,})"))),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """left, value, right, label: findings made by rule, half of them secrets."""
    pick = lambda salt, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    size = lambda salt, low, high: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")
    hexes = F.concat(F.sha2(F.concat(F.lit("a"), "id"), 256), F.sha2(F.concat(F.lit("b"), "id"), 256))
    mixed = F.regexp_replace(F.base64(F.unhex(hexes)), "[+/=\\s]", "")
    cut = lambda x, n: F.substring(x, F.lit(1), n)
    tame = F.array(*[F.lit(s) for s in "the tion ing ment keit ung ver ein que eux ado cion para heit and ther ous able inter over".split()])
    natural = F.array_join(F.transform(F.sequence(F.lit(1), size("w", 5, 9)), lambda i: F.element_at(tame, (F.pmod(F.xxhash64("id", i), F.lit(20)) + 1).cast("int"))), "")
    snake = F.array_join(F.transform(F.sequence(F.lit(1), size("w", 4, 6)), lambda i: F.element_at(tame, (F.pmod(F.xxhash64("id", i, F.lit(1)), F.lit(20)) + 1).cast("int"))), "_")
    uuid = F.regexp_replace(cut(hexes, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    prose = pick("l", "and then the old ", "Er in der ", "que de la ", "les deux ", "see it there ", "")
    name = pick("n", "token", "secret", "api_key", "password", "auth_token", "API_KEY", "private_key", "access-token", "Authorization: Bearer", "client_secret", "AWS_ACCESS_KEY_ID", "aws_secret_access_key")
    sign = pick("s", ' = "', '="', ": '", " = ", ": ", '": "', "=", "=")
    query = F.concat(pick("u", "https://www.site.org/", "http://a.net/b/", "https://api.c.org/v1/list"), pick("u2", "?", "?page=2&", "?id=7&"), pick("n", "token", "api_key", "key", "auth", "access_token", "secret"), F.lit("="))
    bare = pick("n", "Bearer ", "api key ", "key: ", "token ")
    secret = pick("v", cut(hexes, F.lit(40)), cut(hexes, F.lit(40)), cut(hexes, F.lit(32)), cut(hexes, F.lit(64)), cut(mixed, size("m", 20, 48)), cut(mixed, size("m", 24, 64)), F.concat(F.lit("AKIA"), F.upper(cut(mixed, F.lit(16)))), F.concat(F.lit("AKIA"), F.translate(F.upper(cut(mixed, F.lit(16))), "0123456789", "ABCDEFGHIJ")), F.concat(F.lit("ghp_"), cut(mixed, F.lit(36))), F.concat(F.lit("sk-"), cut(mixed, F.lit(40))), F.concat(F.lit("eyJ"), cut(mixed, F.lit(60))), cut(F.concat(F.lit("p@"), mixed), size("m", 9, 16)), F.concat(cut(natural, size("p1", 3, 7)), size("p2", 0, 9999).cast("string"), cut(F.reverse(natural), size("p3", 0, 6)), size("p4", 10, 999).cast("string")))
    secret = F.when(F.length(secret) < 8, F.concat(secret, cut(mixed, F.lit(8)))).otherwise(secret)
    known = F.when(F.rlike(secret, F.lit("^(AKIA|ghp_|sk-|eyJ)")), pick("c", F.concat(name, sign), prose, bare, query, F.lit("https://"))).otherwise(pick("c", F.concat(name, sign), F.concat(name, sign), F.concat(name, sign), bare, query))
    digest = pick("v", cut(hexes, F.lit(40)), cut(hexes, F.lit(64)), cut(hexes, F.lit(32)), uuid)
    digest_at = pick("c", "commit ", "sha256:", "md5 checksum ", "etag: '", "uuid = ", "integrity: ", "revision ", "git hash ", "digest=\"", "COMMIT=", "https://a.net/b?rev=", "http://www.site.org/x?id=7&hash=", "SHA256=")
    path = pick("v", F.concat(F.lit("usr/local/"), snake), F.concat(F.lit("src/"), natural, F.lit("/main")), F.concat(natural, F.lit("-"), natural))
    path_at = pick("c", "https://www.site.org/", "/", "open(\"/", "http://a.net/b/", "see ./")
    filler = pick("v", "your_api_key_goes_here", "xxxxxxxxxxxxxxxxxxxxxxxx", "REPLACE_ME_WITH_A_TOKEN", "example-password-1234567", "aaaaaaaaaaaaaaaaaaaaaaaa", "changeme-changeme-changeme", "abcdef1234567890abcdef")
    kind = F.pmod(F.xxhash64("id", F.lit("kind")), F.lit(16))
    rows = spark.range(n).select("id", kind.alias("kind"))
    value = F.when(F.col("kind") < 8, secret).when(F.col("kind") < 11, natural).when(F.col("kind") < 12, snake).when(F.col("kind") < 14, digest).when(F.col("kind") < 15, path).otherwise(filler)
    left = F.when(F.col("kind") < 8, F.concat(prose, known)).when(F.col("kind") < 11, F.concat(prose, pick("q", "", "", '"', "token of ", "the key: ", "Password: ", "secret = "))).when(F.col("kind") < 12, F.concat(prose, pick("q", "", "key = ", "def ", "name=", "https://a.net/b?page="))).when(F.col("kind") < 14, F.concat(prose, digest_at)).when(F.col("kind") < 15, path_at).otherwise(F.concat(name, sign))
    right = F.when(F.col("kind") == 14, pick("r", ".html", "/index", ".py", "")).otherwise(pick("r", '"', "'", " and the rest", "\n", ""))
    right = F.when((F.col("kind") < 8) & F.rlike(left, F.lit("^https://$")), F.lit("@github.com/a/b")).otherwise(right)
    return rows.select(left.alias("left"), value.alias("value"), right.alias("right"), (F.col("kind") < 8).cast("double").alias("label"))


def forest(labelled: DataFrame, words: DataFrame, seed: int = 1):
    """A forest fitted on TRAIN_ROWS labelled findings at most (those with the least hashes)."""
    held = labelled.orderBy(F.xxhash64("value", "left"), "value", "left", "right", "label").limit(TRAIN_ROWS)
    ready = stage(features(held, words).select(*FEATURES, "label"), "secret-training")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="f_all").transform(ready.repartition(1).sortWithinPartitions(*FEATURES, "label"))
    return RandomForestClassifier(featuresCol="f_all", labelCol="label", numTrees=24, maxDepth=6, minInstancesPerNode=4, seed=seed).fit(vectors)


def judged(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """key, k, start, n_chars, value_sha256, probability, is_secret of each candidate of each different text."""
    spark = docs.sparkSession
    words = stage(dictionary(docs, text_col), "secret-dictionary")
    model = forest(labelled if labelled is not None else labelled_findings(spark), words)
    found = stage(candidates(docs, text_col), "secret-candidates")
    context = found.select("value", "left", "right").distinct()
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="f_all").transform(features(context, words))
    scored = model.transform(vectors).select("value", "left", "right", F.round(vector_to_array("probability")[1], 9).alias("probability"))
    out = found.join(scored, ["value", "left", "right"])
    out = out.select("key", "k", "start", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "probability", (F.col("probability") >= KEEP_AT).alias("is_secret"))
    return stage(out, "secret-findings")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_chars, value_sha256, probability, is_secret: every candidate of every row."""
    found = judged(docs, text_col, labelled)
    rows = docs.filter(with_candidates(docs, text_col)).select(F.col(id_col).alias("doc_id"), F.md5(text_col).alias("key"))
    return rows.join(found, "key").select("doc_id", F.col("start").cast("bigint").alias("start"), "n_chars", "value_sha256", "probability", "is_secret")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", labelled: DataFrame | None = None) -> DataFrame:
    """docs with MASK in place of each secret; rows without one are as they were."""
    found = judged(docs, text_col, labelled).filter("is_secret").groupBy("key").agg(F.collect_set("k").alias("ks"))
    found = found.withColumnRenamed("key", "k_")
    hit = with_candidates(docs, text_col)
    held = docs.filter(hit).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("t_"), F.md5(text_col).alias("key_"))
    held = held.join(found, F.col("key_") == F.col("k_"), "left")
    held = held.select("row", "t_", "ks", F.regexp_extract_all("t_", F.lit(CANDIDATE), F.lit(0)).alias("hits_"), F.split("t_", CANDIDATE, -1).alias("pieces_"))
    built = F.array_join(F.transform("pieces_", lambda p, i: F.concat(p, F.when(F.array_contains("ks", i), MASK).otherwise(F.coalesce(F.get("hits_", i), F.lit(""))))), "")
    held = held.select("row", F.when(F.col("ks").isNull(), F.col("t_")).otherwise(built).alias("t_"), F.col("ks").isNotNull().alias("cut_"))
    fields = {c: F.col("row").getField(c).alias(c) for c in docs.columns}
    fields[text_col] = F.col("t_").alias(text_col)
    if chars_col in fields:
        fields[chars_col] = F.when(F.col("cut_"), F.length("t_").cast(docs.schema[chars_col].dataType)).otherwise(F.col("row").getField(chars_col)).alias(chars_col)
    return docs.filter(~hit).unionByName(held.select(*fields.values()))
