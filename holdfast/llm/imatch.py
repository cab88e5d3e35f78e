"""Document fingerprints by I-Match.

Terms (lower-cased runs of letters and digits) whose document frequency, counted
over different texts, lies in a band are the lexicon: a group of copies is one text, however many rows it holds, and too common terms say nothing, too rare ones are noise.
A document keeps its distinct terms of the lexicon, sorted, and is hashed once
for each of several randomised subsets of the lexicon. A term's own hash deals
it to subsets at three rates (1/8, 1/64, 1/512), so that short and long texts
both meet subsets in which they have about one term. The likeness of two
fingerprints is the share of subsets, among those where either has a term,
whose hashes agree, at the rate where that is highest.

Scale: document frequencies are one partial aggregation over all different texts.
Texts are counted by digest; only of those that occur again the rows are met
with their digests (broadcast up to BROADCAST_TERMS, counted) and one is kept,
so no other text is shuffled for it. The
lexicon has at most (mean distinct terms of a document) / LOW terms, whatever
the number of documents (18,000 for the documents here); it becomes one set
that terms are looked up in, so no term is shuffled, joined or grouped. Only
ids and hashes are put in order, in ranges of about PER_RANGE rows by sampled
bounds, however the ids are spread; each text then gives its neighbour the
characters that it needs, by a join on (id, hash).

Defined results: a null text is the empty text; a text without a term of the
lexicon is fingerprinted by its own digest, and alike only to an equal text;
documents are ordered by doc_id descending, null last, equal ids by a hash of
their text; repeated rows (equal id and text) are one document with one neighbour and give a
row each; a single
document is its own neighbour; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import stage

LOW, HIGH = 0.002, 0.2
#: (bits to skip in the term's hash, parts the lexicon is dealt to, parts used)
RATES = ((0, 8, 8), (3, 64, 24), (9, 512, 32))
#: Subsets that a rate needs with a term before its share counts in full.
ENOUGH = 4
BROADCAST_TERMS = 500_000
PER_RANGE = 200_000


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """term, tid (its hash) of the terms whose share of all different texts lies in [low, high] and that two have at least."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.unhex(F.md5("text")))
    counts = stage(texts.groupBy("h").agg(F.count("*").alias("c")), "imatch-texts")
    n, again = counts.count(), counts.filter("c > 1").select("h")
    small = again.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    again = F.broadcast(again) if small else again
    once = texts.join(again, "h", "left_anti").select("text")
    copied = texts.join(again, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")).select("text")
    df = once.unionByName(copied).select(F.explode(terms(F.col("text"))).alias("term")).filter("term != ''").groupBy("term").agg(F.count("*").alias("df"))
    return df.filter((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n))).select("term", F.xxhash64("term").alias("tid"))


def known_terms(lex: DataFrame) -> Callable[[str], Column]:
    """Name of a column of terms -> the sorted hashes of those that the lexicon has."""
    held = ",".join(f"{r['tid']}L" for r in lex.select("tid").collect())  # bounded: see Scale above

    def known(name: str) -> Column:
        if not held:
            return F.array().cast("array<bigint>")
        return F.expr(f"array_sort(array_distinct(filter(transform(`{name}`, x -> xxhash64(x)), x -> x IN ({held}))))")

    return known


def subset_hashes(tids: Column) -> Column:
    """array<bigint> over all subsets: a 32-bit hash of the sorted tids in each, null where none is."""
    out = []
    for skip, parts, used in RATES:
        part = lambda t, s=skip, p=parts: F.shiftrightunsigned(t, s).bitwiseAND(p - 1)
        held = tids if used == parts else F.filter(tids, lambda t: part(t) < used)
        one = lambda j, held=held, part=part: F.filter(held, lambda t: part(t) == j)
        subsets = F.transform(F.sequence(F.lit(0), F.lit(used - 1)), lambda j: one(j))  # noqa: B023,PLW0108
        out.append(F.transform(subsets, lambda x: F.when(F.size(x) > 0, F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)))))
    return F.concat(*out)


def shown(hashes: Column, text_hash: Column) -> Column:
    """The fingerprint: eight hex digits or a hyphen for each subset; the text's own digest if no subset has a term."""
    own = F.array_join(F.transform(hashes, lambda h: F.when(h.isNull(), "-").otherwise(F.lower(F.lpad(F.hex(h), 8, "0")))), "")
    return F.when(F.exists(hashes, lambda h: h.isNotNull()), own).otherwise(F.concat(F.lit("text:"), text_hash))


def likeness(a: Column, b: Column, same_text: Column) -> Column:
    shares, at = [], 1
    for _, _, used in RATES:
        pairs = F.arrays_zip(F.slice(a, at, used).alias("x"), F.slice(b, at, used).alias("y"))
        met = F.filter(pairs, lambda p: p.x.isNotNull() | p.y.isNotNull())
        agree = F.filter(pairs, lambda p: p.x == p.y)
        shares.append(F.size(agree) / F.greatest(F.size(met), F.lit(ENOUGH)))
        at += used
    return F.when(same_text, F.lit(1.0)).otherwise(F.greatest(*shares))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th (hash of the text), text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def followed(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, th, p_id, p_th, third) for each different (doc_id, th), and whether rows repeat.

    p is the document that this one comes next after, by descending id, and
    third the characters that p needs of it.
    """
    spark = rows.sparkSession
    ids = stage(rows.groupBy("doc_id", "th").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("c")), "imatch-ids")
    total, again = ids.agg(F.count("*"), F.max("c")).first()
    parts = max(1, -(-total // PER_RANGE))
    ranged = ids.select("doc_id", "th", "n").repartitionByRange(parts, F.desc_nulls_last("doc_id"), F.asc("th"))
    ranged = stage(ranged.withColumn("range", F.spark_partition_id()), "imatch-ranges")
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("bigint")).alias("r"), "th", "doc_id", "n")
    ends = sorted(ranged.groupBy("range").agg(F.max(place).alias("last")).collect())  # a row for every PER_RANGE rows
    marks = [(r["range"], ends[k - 1]["last"]["doc_id"], ends[k - 1]["last"]["th"], ends[k - 1]["last"]["n"]) for k, r in enumerate(ends)]
    marks = spark.createDataFrame(marks, "range int, m_id bigint, m_th bigint, m_n int")
    own = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "th")
    named = ranged.withColumn("p", F.lag(F.struct("doc_id", "th", "n")).over(own)).join(F.broadcast(marks), "range")
    before = F.coalesce("p", F.struct(F.col("m_id").alias("doc_id"), F.col("m_th").alias("th"), F.col("m_n").alias("n")))
    named = named.select("doc_id", "th", before.alias("p"))
    return named.select("doc_id", "th", F.col("p.doc_id").alias("p_id"), F.col("p.th").alias("p_th"), F.floor(F.col("p.n") / 3).cast("int").alias("third")), (again or 0) > 1


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """doc_id, th, text, piece, next_id, next_th of each row: piece is what the edited text takes of the next document."""
    rows = _rows(docs, id_col, text_col)
    order, repeats = followed(rows)
    order = order.withColumnsRenamed({"doc_id": "o_id", "th": "o_th"})
    given = rows.join(order, rows.doc_id.eqNullSafe(F.col("o_id")) & (rows.th == F.col("o_th")))
    given = given.select("p_id", "p_th", F.expr("substring(text, 1, third)").alias("piece"), F.col("o_id").alias("next_id"), F.col("o_th").alias("next_th"))
    given = given.dropDuplicates(["p_id", "p_th"]) if repeats else given
    rows = _rows(docs, id_col, text_col)
    return rows.join(given, rows.doc_id.eqNullSafe(F.col("p_id")) & (rows.th == F.col("p_th"))).drop("p_id", "p_th"), repeats


def fingerprint(docs: DataFrame, lex: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of each row's text."""
    known = known_terms(lex)
    rows = _rows(docs, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("t"), terms(F.col("text")).alias("w"))
    held = rows.select("doc_id", "t", known("w").alias("tids")).select("doc_id", "t", subset_hashes(F.col("tids")).alias("hashes"))
    return held.select("doc_id", shown(F.col("hashes"), F.col("t")).alias("fingerprint"))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document's.

    The edited text has the last third of the code points replaced by the first
    ones of the next document.
    """
    known = known_terms(stage(lexicon(docs, text_col), "imatch-lexicon"))
    near, repeats = with_next(docs, id_col, text_col)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.col("piece"))
    ids = ["doc_id", "th", "next_id", "next_th"]
    texts = near.select(*ids, "text", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    keep = [*ids, "n_chars", "own_sha", "edited_sha256"]
    cut = texts.select(*ids, "n_chars", F.sha2("text", 256).alias("own_sha"), F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("text")).alias("w"), terms(F.col("edited")).alias("we"))
    found = cut.select(*keep, known("w").alias("t"), known("we").alias("te"))
    held = stage(found.select(*keep, subset_hashes(F.col("t")).alias("own"), subset_hashes(F.col("te")).alias("edited")), "imatch-prints")
    other = held.select(F.col("doc_id").alias("x_id"), F.col("th").alias("x_th"), F.col("own").alias("next"), F.col("own_sha").alias("next_sha"))
    other = other.dropDuplicates(["x_id", "x_th"]) if repeats else other
    out = held.join(other, F.col("next_id").eqNullSafe(F.col("x_id")) & (F.col("next_th") == F.col("x_th")))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("own"), F.col("own_sha")).alias("fingerprint"),
        shown(F.col("edited"), F.col("edited_sha256")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), F.col("own_sha") == F.col("edited_sha256")).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), F.col("own_sha") == F.col("next_sha")).alias("near_next"),
    )
