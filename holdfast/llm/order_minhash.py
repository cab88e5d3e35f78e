"""Near-duplicate classes by Order MinHash and banded alignment.

A text's words (runs of letters, digits and underscores, lower-cased) give
k-mers of K words, each labelled by its occurrence number, so a repeated
passage counts as often as it stands there. For each of SKETCHES hash
functions the ELL smallest labelled k-mers are kept in text order and hashed
together: two texts agree on a sketch where they share those k-mers *and*
their order, which makes agreement follow edit similarity. Texts that agree on
a sketch are candidates, and a banded alignment of the words decides: a pair is
a link if 1 - (insertions + deletions) / (words of both) is SIMILAR or more.
Classes are the connected components of the links.

Candidates: one changed word takes K k-mers with it, so with one word in ten
changed here and there (similarity 0.9) two texts still share 0.42 of their
k-mers, agree on a sketch with probability 0.42 ** 3 and on one of 48 with
0.97; at 0.88 with 0.9, at 0.85 with 0.68, at the limit of 0.8 with 0.3. Edits
that stand together cost fewer k-mers and are found with more. Two k-mers a
sketch would find 0.87 at the limit, but texts around common passages then meet
so often that the work outgrows the input (README). Texts of up to
SHORT words, where a few edits leave no k-mer, and all that can be similar to
them, also stand under those of their words of which two texts of similarity
SIMILAR must share one (longest first, an order that all texts agree on): no
link among them is lost.

What is tested before a pair is aligned follows from the similarity alone, so
it costs no link: with n and m words, SIMILAR * (n + m) / 2 words must be
matched, hence neither text is shorter than that, and as many words must occur
in both, whatever their order.

Scale: equal texts are one node (hash of the text), so a group of copies costs
one text. Buckets of up to SMALL texts compare all; in a larger one its members
meet a leader (the most central member), not each other. Members that end
outside their leader's component meet the others through their rarest words:
two texts of similarity SIMILAR must share one of the rarest third of each (the
prefix and place filters of set joins, which lose nothing), while texts around
a common passage have rare words of their own; only texts that are two thirds
one passage still meet in numbers, in rounds with sixteen times as many leaders
each until every such member has led. So of two members of a bucket either both
are in one component, or they are compared, or they cannot be similar. Words of
candidates are fetched once, through a broadcast of their hashes only while
these are at most BROADCAST_NODES. Buckets, leaders and components are
aggregations with partial steps and inner joins that Spark can split at a
skewed key; labels are carried from round to round and only new links are
contracted; results between rounds are tables in the shared folder.

Defined results: a null text is the empty text; texts without words are in a
class only with equal texts; repeated rows each give a row; class_id is the
least doc_id of a class, null if it has none; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import release_memory, stage

K = 5
SKETCHES, ELL = 48, 3
SIMILAR = 0.8
SHORT = 24
SMALL = 8
BROADCAST_NODES = 500_000
PLACES, _PLACE = 1 << 17, np.uint64(64 - 17)
_WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_RNG = np.random.default_rng(4)
_XOR = _RNG.integers(0, 2**63, SKETCHES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64(2**64 - 1)


class _WordHashes(dict):
    """word -> 64-bit hash, worked out once a word."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def forget() -> None:
    """At a task's end: the worker lives on."""
    _HASHES.clear()
    release_memory()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


def labelled(w: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers of a word sequence, in text order; all different."""
    n = len(w) - k + 1
    if not len(w):
        return w
    if n < 1:
        k, n = len(w), 1
    s = np.full(n, np.uint64(k))
    for i in range(k):
        s = _mix((s + w[i : i + n]) * _M1)
    order = np.argsort(s, kind="stable")
    t = s[order]
    same = t[1:] == t[:-1]
    if same.any():
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        occurrence = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        label = np.empty(n, np.uint64)
        label[order] = occurrence.astype(np.uint64)
        s = np.where(label > 0, _mix(s + label * _M1), s)
    return s


def sketch(x: np.ndarray) -> np.ndarray:
    """SKETCHES values of a labelled k-mer sequence: hashes of the ELL minima in text order."""
    n, out = len(x), np.empty(SKETCHES, np.uint64)
    step = max(1, min(SKETCHES, 500_000 // max(n, 1)))
    for a in range(0, SKETCHES, step):
        v = (x[None, :] ^ _XOR[a : a + step, None]) * _MUL[a : a + step, None]
        v ^= v >> np.uint64(32)
        rows, at = np.arange(len(v)), []
        for _ in range(min(ELL, n)):
            at.append(v.argmin(axis=1))
            v[rows, at[-1]] = _LAST
        kept = x[np.sort(np.stack(at, 1), axis=1)]
        h = _XOR[a : a + step] * _M1
        for i in range(kept.shape[1]):
            h = _mix((h + kept[:, i]) * _M1)
        out[a : a + step] = h
    return out


def matches(n: int, least: float) -> int:
    """Words of a text of n that any text of similarity `least` shares with it."""
    return int(np.ceil(least * n / (2 - least) - 1e-9))


def first(found: list[str], w: np.ndarray, least: float) -> np.ndarray:
    """Of a text that can be similar to one of SHORT words: the labelled words, longest first, of which a similar text has one."""
    n = len(found)
    if matches(n, least) > SHORT:
        return w[:0]
    x = labelled(w, 1)
    order = np.lexsort((x, [-len(v) for v in found]))
    return _mix(x[order[: n - matches(n, least) + 1]] + _M1)


def matched(a: list[int], b: list[int], band: int) -> int:
    """Words that an alignment within `band` diagonals of the main one can match.

    One bit a word of a: each word of b is one addition over the bits that its
    band can reach, and a bit that turns 0 is a match. Bits that the band has
    left are counted and dropped.
    """
    n, m = len(a), len(b)
    step = max(band, 64)
    low, high, v, done = 0, 0, 0, 0
    for j in range(0, m, step):
        to_low, to_high = min(max(low, j - band), n), min(n, j + step + band)
        if (gone := min(to_low, high) - low) > 0:
            done += gone - (v & ((1 << gone) - 1)).bit_count()
            v >>= gone
        if to_high > high:
            v |= ((1 << (to_high - high)) - 1) << (high - to_low)
        low, high = to_low, to_high
        if high <= low:
            break
        at: dict[int, int] = {}
        for i, w in enumerate(a[low:high]):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << (high - low)) - 1
        for w in b[j : j + step]:
            if x := at.get(w):
                u = v & x
                v = (v + u | v - u) & full
    return done + (high - low) - v.bit_count()


def similarity(wa: np.ndarray, wb: np.ndarray, least: float = SIMILAR) -> tuple[bool, float | None]:
    """(whether the words were aligned, their edit similarity if it is `least` or more)."""
    total = len(wa) + len(wb)
    edits = int((1 - least) * total + 1e-9)
    if not len(wa) or not len(wb) or abs(len(wa) - len(wb)) > edits:
        return False, None
    need = (total - edits + 1) // 2
    if len(np.intersect1d(labelled(wa, 1), labelled(wb, 1), assume_unique=True)) < need:
        return False, None
    short = min(len(wa), len(wb))
    head = short if (wa[:short] == wb[:short]).all() else int(np.argmin(wa[:short] == wb[:short]))
    ra, rb = wa[head:][::-1], wb[head:][::-1]
    short = min(len(ra), len(rb))
    tail = short if (ra[:short] == rb[:short]).all() else int(np.argmin(ra[:short] == rb[:short]))
    same = head + tail
    same += matched(ra[tail:].tolist(), rb[tail:].tolist(), edits)
    return True, (2 * same / total if same >= need else None)


def _sketcher(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, flat, at = [], [], [0]
            for t in b.column(2):
                found = words_of(t.as_py())
                n.append(len(found))
                w = word_hashes(found)
                keys = np.concatenate([sketch(labelled(w)), first(found, w, least)]).astype(np.int64) if found else np.empty(0, np.int64)
                flat.append(keys)
                at.append(at[-1] + len(keys))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)], names=["doc_id", "h", "n", "keys"])
        forget()

    return run


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        w = [word_hashes(words_of(t.as_py())).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.binary())], names=["h", "w"])
    forget()


def _words_in(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _verifier(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tested = [similarity(_words_in(a), _words_in(b), least) for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in tested], pa.bool_()), pa.array([x for _, x in tested], pa.float64())], names=["a", "b", "aligned", "sim"])
        release_memory()

    return run


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("h"), text.alias("text"))


def sized(members: DataFrame) -> DataFrame:
    """Members, with the size c of their bucket, of buckets that hold two components at least, one of them with an open member."""
    own = Window.partitionBy("key")
    found = members.withColumns({"c": F.count("*").over(own), "lo": F.min("comp").over(own), "hi": F.max("comp").over(own), "o": F.max("open").over(own)})
    return found.filter("lo <> hi AND o").drop("lo", "hi", "o")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, PLACES), np.int64)
    for b in batches:
        for is_open, w in zip(b.column(0), b.column(1)):
            here = np.bincount((labelled(_words_in(w), 1) >> _PLACE).astype(np.int64), minlength=PLACES)
            counts[0] += here
            counts[1] += here if is_open.as_py() else 0
    at = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["place", "n", "n_open"])
    release_memory()


def _rarest_of(counts: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, words, ranks = [], [], []
            for is_open, w in zip(b.column(2), b.column(4)):
                x = labelled(_words_in(w), 1)
                place = (x >> _PLACE).astype(np.int64)
                order = np.lexsort((x, counts[0, place]))[: len(x) - matches(len(x), least) + 1]
                # a word that no other node has, or no open one where this is not open, is met by nobody
                met = counts[0, place[order]] > 1 if is_open.as_py() else counts[1, place[order]] > 0
                at = np.flatnonzero(met)
                n.append(len(x))
                words.append(x[order[at]].astype(np.int64))
                ranks.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32()))], names=["h", "score", "open", "groups", "n", "word", "at"])
        release_memory()

    return run


def rarest(words: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """key, h, n, score, at, open: of each node (h, score, open, groups) the words that a text of similarity `least` must share one of.

    All texts must put their words in one order, the rarest first. Labelled
    words are counted by their hash in PLACES places, which is exact enough for
    an order and a table of bounded size, so no word is joined with its count.
    Of n words the first n - matches(n) + 1 are given (at counts those before
    it), without those that stand alone in their place or, for a node that is
    not open, that no open one has, once for each of the node's groups: a key
    is a word in a group.
    """
    held = stage(words.join(nodes, "h").select("h", "score", "open", "groups", "w"), "omh-rest")
    counted = held.select("open", "w").mapInArrow(_places, "place bigint, n bigint, n_open bigint").groupBy("place").agg(F.sum("n").alias("n"), F.sum("n_open").alias("o")).collect()  # PLACES rows at most
    counts = np.zeros((2, PLACES), np.int64)
    for r in counted:
        counts[:, r["place"]] = r["n"], r["o"]
    # dealt by text: nodes that met in one bucket stand together in few files
    given = held.repartition("h").mapInArrow(_rarest_of(counts, least), "h binary, score bigint, open boolean, groups array<binary>, n int, word array<bigint>, at array<int>")
    each = given.select("h", "n", "score", "open", "groups", F.explode(F.arrays_zip("word", "at")).alias("x")).select("h", "n", "score", "open", "x.at", "x.word", F.explode("groups").alias("g"))
    return each.select(F.xxhash64("g", "word").alias("key"), "h", "n", "score", "at", "open")


def _met(left: DataFrame, leaders: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(pairs key, h, lh to test; leaders key, h): all pairs of buckets of up to SMALL, members with leaders in others."""
    other = lambda x: x.select("key", *[F.col(c).alias("l" + c) for c in ("h", "n", "at", "comp", "open")])
    # words that the two can match at most, given their numbers and the places of this one, reach `least`
    alike = F.least(F.col("n") - F.col("at"), F.col("ln") - F.col("lat")) >= (F.col("n") + F.col("ln")) * F.lit(least / 2) - 1e-9
    fit = (F.col("comp") != F.col("lcomp")) & alike
    small, large = left.filter(F.col("c") <= SMALL), left.filter(F.col("c") > SMALL)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "h"))
    lead = large.filter("open").withColumn("r", rank).filter(F.col("r") <= leaders).drop("r")
    some = small.join(other(small), "key").filter(fit & (F.col("h") < F.col("lh")) & (F.col("open") | F.col("lopen")))
    more = large.join(other(lead), "key").filter(fit)
    return some.select("key", "h", "lh").unionByName(more.select("key", "h", "lh")), lead.select("key", "h")


def relabel(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """label (node, label) after more links (a, b): components of the labels that the links join, then of their nodes."""
    if label is None:
        return components(links)
    of = label.select(F.col("node").alias("x"), F.col("label").alias("y"))
    a = links.join(of, F.col("a") == F.col("x"), "left").select(F.coalesce("y", "a").alias("a"), "b")
    b = a.join(of, F.col("b") == F.col("x"), "left").select("a", F.coalesce("y", "b").alias("b"))
    new = components(b)
    moved = label.join(new.select(F.col("node").alias("x"), F.col("label").alias("y")), F.col("label") == F.col("x"), "left").select("node", F.coalesce("y", "label").alias("label"))
    return stage(moved.unionByName(new), "omh-label")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, tested, label).

    rows: doc_id, h of each document; tested: a, b, aligned, sim of the pairs of
    hashes of different texts that were compared (sim null: no link); label:
    node, label of the texts that have links.
    """
    spark, texts = docs.sparkSession, _hashed(docs, id_col, text_col)
    rows = stage(texts.mapInArrow(_sketcher(least), "doc_id bigint, h binary, n int, keys array<bigint>"), "omh-sketches")
    nodes = rows.filter("n > 0").groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    keys = nodes.select("h", "rep", "n", F.explode("keys").alias("key"))
    full = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    left = stage(keys.join(full, "key"), "omh-members")
    own = stage(left.groupBy("h").agg(F.min("rep").alias("rep"), F.sum("c").alias("score")), "omh-candidates")
    n_own = own.count()
    tested, label = spark.createDataFrame([], "a binary, b binary, aligned boolean, sim double"), spark.createDataFrame([], "node binary, label binary")
    if not n_own:
        return rows.select("doc_id", "h"), tested, label
    small = n_own <= BROADCAST_NODES
    wanted = own.select("h", "rep")
    fetched = texts.join(F.broadcast(wanted) if small else wanted, "h").filter(F.col("doc_id").eqNullSafe(F.col("rep")))
    words = stage(fetched.groupBy("h").agg(F.first("text").alias("text")).mapInArrow(_hash_words, "h binary, w binary"), "omh-words")
    left = left.join(own.select("h", "score"), "h").select("key", "h", "n", "score", F.lit(0).alias("at"), F.lit(True).alias("open"), F.col("h").alias("comp"), "c")
    label, leaders = None, 1
    while True:
        left = stage(left, "omh-left")
        if left.isEmpty():
            break
        met, led = _met(left, leaders, least)
        pairs = met.select(F.least("lh", "h").alias("a"), F.greatest("lh", "h").alias("b")).distinct()
        if label is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        with_words = pairs.join(words.select(F.col("h").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("h").alias("b"), F.col("w").alias("wb")), "b")
        new = stage(with_words.select("a", "b", "wa", "wb").mapInArrow(_verifier(least), "a binary, b binary, aligned boolean, sim double"), "omh-tested")
        first_round, tested = label is None, tested.unionByName(new)
        label = relabel(label, new.filter("sim IS NOT NULL").select("a", "b"))
        named = label.withColumnRenamed("node", "h")
        if first_round:
            # open: who is not in the component of its bucket's leader; buckets whose leaders are in one component are one group
            heads = led.join(named, "h", "left").select("key", F.coalesce("label", "h").alias("g"))
            held = left.drop("comp").join(named, "h", "left").withColumn("comp", F.coalesce("label", "h")).join(heads, "key")
            held = stage(held.groupBy("g", "h").agg(F.max("score").alias("score"), F.max(F.col("comp") != F.col("g")).alias("open")), "omh-over")
            over = held.filter("open").select("g").distinct()
            near = held.join(over, "g").groupBy("h").agg(F.max("score").alias("score"), F.max("open").alias("open"), F.collect_set("g").alias("groups"))
            near = stage(near, "omh-near")
            if near.isEmpty():
                break
            left = rarest(words, near, least)
        else:
            # buckets of up to SMALL are done, and a leader has met all of its bucket
            turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("open"), F.desc("score"), "h"))
            left = left.filter(F.col("c") > SMALL).withColumn("r", turn).filter(~F.col("open") | (F.col("r") > leaders)).drop("r", "comp", "c")
            leaders *= 16
        left = sized(left.join(named, "h", "left").withColumn("comp", F.coalesce("label", "h")).drop("label"))
    return rows.select("doc_id", "h"), tested, label


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for edges (a, b); alternating star contraction."""
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc-edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stage(small, "cc-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """doc_id, text_hash, class_id, n_texts (different texts in the class), kept (the one that stays) for each row."""
    rows, _, label = links(docs, id_col, text_col, least)
    nodes = rows.groupBy("h").agg(F.min("doc_id").alias("low"))
    nodes = nodes.join(label.withColumnRenamed("node", "h"), "h", "left").select("h", "low", F.coalesce("label", "h").alias("label"))
    least_ids = nodes.groupBy("label").agg(F.min("low").alias("class_id"), F.count("*").alias("n_texts"))
    named = nodes.join(least_ids, "label").select("h", "class_id", "n_texts")
    return rows.join(named, "h").select("doc_id", F.lower(F.hex("h")).alias("text_hash"), "class_id", "n_texts", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """docs with one row of each class, all columns as they were.

    The others' ids go by an anti join. Where rows share id and text, or have
    no id, the first of equal rows stays.
    """
    judged = stage(classes(docs, id_col, text_col, least).select("doc_id", "text_hash", "kept"), "omh-kept")
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("i_"), F.col("text_hash").alias("h_")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id_"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("hash_"))
    small = gone.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    gone = F.broadcast(gone) if small else gone
    held = held.join(gone, held.id_.eqNullSafe(F.col("i_")) & (F.col("hash_") == F.col("h_")), "left_anti")
    stays = judged.filter("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("c")).filter("c > 1")
    if not stays.isEmpty():
        held = held.groupBy("id_", "hash_").agg(F.first("row").alias("row"))
    return held.select("row.*")
