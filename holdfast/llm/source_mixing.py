"""Mixing sources to target weights.

A source's documents, in a fixed pseudorandom order, form one stream of words
that is cut into blocks of BLOCK words. The targets fix how many words each
source gives; output shards draw their source counts multinomially from what
is left of each source, so that all shards together take exactly the targets.
Slot j of a source takes the block at place j of the source's pseudorandom
permutation (a keyed Feistel network, walked until it falls into the range; a
second pass over the source is a second permutation); slots and blocks join by
(source, block). The last slot of a source takes only the words still missing,
so a source's taken words are its target, rounded.

Scale: documents are ordered by window functions inside (source, hash bucket),
so no task holds a whole source, and bucket totals give each bucket its place.
Slots come from spark.range, not from a group. Only per-source totals and
shards x sources counts reach the driver: a row per source of the mix.

Defined results: a null text has no words, takes nothing; a null source is a
source of its own, last in order; repeated rows are documents of their own;
empty sources get target 0; an empty table gives no rows; extra columns are
ignored (mixed_documents returns them). The weights repeat over the sources.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import release_memory, stage

BLOCK = 256
SHARDS = 64
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SEED = 20_240_601
PER_BUCKET = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def fill(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets: share of the sum by weight; what exceeds most * size is dealt out again by weight."""
    target, free, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    left = min(left, most * sum(sizes))
    while free and left > 0:
        per = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * per > most * sizes[i]]
        for i in over or free:
            target[i] = most * sizes[i] if over else weights[i] * per
        left -= sum(target[i] for i in over)
        if not over:
            break
        free = [i for i in free if i not in set(over)]
    return target


def shard_counts(slots: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """shards x sources counts: multinomial draws from what is left of each source; columns sum to slots."""
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for h in range(shards):
        need = int(left.sum()) // (shards - h)
        while need > 0:
            draw = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[h] += draw
            left -= draw
            need -= int(draw.sum())
    return out


def permute(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A bijection of [0, n) for each key: four Feistel rounds, walked into the range."""
    return _walk(_feistel, place, n, key)


def place_of(value: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place that permute() takes to value."""
    return _walk(_feistel_back, value, n, key)


def _walk(step, place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    place, n, key = place.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2).astype(np.uint64), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = place.copy(), np.arange(len(place))
    while len(todo):
        x[todo] = y = step(x[todo], half[todo], mask[todo], key[todo])
        todo = todo[y >= n[todo]]
    return x.astype(np.int64)


def _round(b, mask, key, r):
    f = (b + key * np.uint64(2 * r + 1)) * np.uint64(0x9E3779B97F4A7C15)
    f ^= f >> np.uint64(29)
    f *= np.uint64(0xBF58476D1CE4E5B9)
    f ^= f >> np.uint64(32)
    return f & mask


def _feistel(x, half, mask, key):
    a, b = x >> half, x & mask
    for r in range(4):
        a, b = b, a ^ _round(b, mask, key, r)
    return (a << half) | b


def _feistel_back(x, half, mask, key):
    a, b = x >> half, x & mask
    for r in reversed(range(4)):
        a, b = b ^ _round(a, mask, key, r), a
    return (a << half) | b


def key_of(source: str | None, turn: int, seed: int = SEED) -> int:
    return int.from_bytes(hashlib.sha256(repr((seed, turn, source)).encode()).digest()[:8], "little") >> 1


class Plan:
    """What the driver knows: a row per source. sources: list of (source, size, blocks, target, slots)."""

    def __init__(self, totals: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, shards=SHARDS, seed=SEED):
        totals = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be", "surrogatepass")))
        self.sources = [s for s, _ in totals]
        self.sizes = [n for _, n in totals]
        self.block, self.seed = block, seed
        self.targets = fill(self.sizes, [float(weights[i % len(weights)]) for i in range(len(totals))], share, most)
        self.blocks = [-(-n // block) for n in self.sizes]
        self.words = [min(round(t), int(most * n)) for t, n in zip(self.targets, self.sizes)]
        self.slots, self.last = zip(*[self._slots(i) for i in range(len(totals))]) if totals else ((), ())
        self.counts = shard_counts(list(self.slots), shards, seed) if sum(self.slots) else np.zeros((0, 0), dtype=np.int64)

    def _order(self, i: int, start: int, stop: int) -> np.ndarray:
        """Blocks of the slots start..stop of source i."""
        n = self.blocks[i]
        j = np.arange(start, stop)
        keys = np.array([key_of(self.sources[i], int(t), self.seed) for t in range(int(stop // n) + 1)], dtype=np.int64)
        return permute(j % n, np.full(len(j), n), keys[j // n])

    def _block_words(self, i: int, b: int) -> int:
        return min(self.block, self.sizes[i] - b * self.block)

    def _slots(self, i: int) -> tuple[int, int]:
        """(number of slots, words of the last one): the short block of a source is met once a pass."""
        want, n, size = self.words[i], self.blocks[i], self.sizes[i]
        if not want:
            return 0, 0
        passes, rest = divmod(want, size)
        short = size - (n - 1) * self.block
        slots = passes * n
        if not rest:
            last = int(self._order(i, slots - 1, slots)[0])
            return slots, self._block_words(i, last)
        # where in this pass the short block stands: its place decides how far rest words reach
        for k in (-(-rest // self.block), -(-(rest + self.block - short) // self.block)):
            inside = self._short_before(i, passes, k)
            have = (k - 1) * self.block - (self.block - short) * inside
            last = self._block_words(i, int(self._order(i, slots + k - 1, slots + k)[0]))
            if 0 < rest - have <= last:
                return slots + k, rest - have
        raise AssertionError("no slot count fits")

    def _short_before(self, i: int, turn: int, k: int) -> bool:
        """Is the short block among the first k - 1 slots of a pass? Its slot is where the permutation, walked back, comes from."""
        n = self.blocks[i]
        key = np.array([key_of(self.sources[i], turn, self.seed)], dtype=np.int64)
        return int(place_of(np.array([n - 1]), np.array([n]), key)[0]) < k - 1


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, text_hash, copy: a row for each row of docs, kept in the shared folder.

    copy numbers rows of the same id, text and source, so each is told apart.
    """
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n.alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    own = Window.partitionBy("doc_id", "text_hash", "source").orderBy("size")
    return stage(rows.withColumn("copy", F.row_number().over(own)), "mix-sizes")


def plan_of(rows: DataFrame, **options) -> tuple[Plan, DataFrame]:
    """The plan, and rows with source_no; the driver gets one row per source."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    plan = Plan([(r["source"], int(r["n"])) for r in totals], **options)
    rows_of = {r["source"]: r["docs"] for r in totals}
    spark = rows.sparkSession
    numbers = spark.createDataFrame([(s, i, n, float(t), max(1, -(-rows_of[s] // PER_BUCKET))) for i, (s, n, t) in enumerate(zip(plan.sources, plan.sizes, plan.targets))], "s_ string, source_no int, source_size bigint, target double, buckets bigint")
    numbers = F.broadcast(numbers) if len(plan.sources) <= 100_000 else numbers
    return plan, rows.join(numbers, rows.source.eqNullSafe(F.col("s_"))).drop("s_")


def placed(rows: DataFrame) -> DataFrame:
    """rows with start: the words of the source before the row's own.

    Order within a source: (bucket, id, hash, copy), bucket being a hash of the
    id; a source has a bucket for each PER_BUCKET rows of its own.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("buckets"))).drop("buckets")
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "text_hash", "copy").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("t"))
    base = totals.select("source_no", "bucket", F.coalesce(F.sum("t").over(across), F.lit(0)).alias("base"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(base, ["source_no", "bucket"]).withColumn("start", F.col("inside") + F.col("base")).drop("inside", "base", "bucket")


def slots_of(plan: Plan, spark) -> DataFrame:
    """(shard, slot, source_no, pass_no, block, take): every slot of every output shard.

    spark.range deals the slots; shard and source follow from the shards x
    sources counts, which travel with the function.
    """
    flat = plan.counts.reshape(-1)
    ends = np.cumsum(flat)
    n_sources = len(plan.sources)
    before = (np.cumsum(plan.counts, axis=0) - plan.counts).reshape(-1)
    blocks, slots, last = np.array(plan.blocks, np.int64), np.array(plan.slots, np.int64), np.array(plan.last, np.int64)
    turns = max((-(-int(s) // max(int(n), 1)) for s, n in zip(slots, blocks)), default=0) + 1
    keys = np.array([[key_of(s, t, plan.seed) for t in range(turns)] for s in plan.sources], dtype=np.int64)
    sizes, block = np.array(plan.sizes, np.int64), plan.block

    def run(batches):
        for b in batches:
            k = b["id"].to_numpy()
            cell = np.searchsorted(ends, k, side="right")
            src = cell % n_sources
            j = before[cell] + k - (ends[cell] - flat[cell])
            n = blocks[src]
            at = permute(j % n, n, keys[src, j // n])
            take = np.minimum(block, sizes[src] - at * block)
            take = np.where(j == slots[src] - 1, last[src], take)
            yield pd.DataFrame({"shard": (cell // n_sources).astype(np.int32), "slot": j, "source_no": src.astype(np.int32), "pass_no": (j // n).astype(np.int32), "block": at, "take": take})

    total = int(sum(plan.slots))
    parts = max(1, min(total // 50_000 + 1, 10_000))
    return spark.range(0, total, 1, parts).mapInPandas(run, "shard int, slot bigint, source_no int, pass_no int, block bigint, take bigint")


KEY = ["doc_id", "text_hash", "source_no", "copy"]


def pieces_of(rows: DataFrame, plan: Plan) -> DataFrame:
    """Parts of documents that slots take: KEY, pass_no, shard, slot, from_word, n_taken."""
    block = plan.block
    at = placed(rows.filter("size > 0"))
    first, end = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spread = at.select(*KEY, "start", "size", F.explode(F.sequence(first, end)).alias("block"))
    met = spread.join(slots_of(plan, rows.sparkSession), ["source_no", "block"])
    low = F.greatest("start", F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    return met.filter(high > low).select(*KEY, "pass_no", "shard", "slot", (low - F.col("start")).alias("from_word"), (high - low).alias("n_taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs."""
    plan, rows = plan_of(sizes_of(docs, id_col, text_col, source_col), **options)
    own = [*KEY, "source", "size", "source_size", "target"]
    zero = rows.select(*own, F.lit(0).cast("bigint").alias("n_taken"))
    got = pieces_of(rows, plan).select(*KEY, *[F.lit(None).cast(t).alias(c) for c, t in (("source", "string"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"))], "n_taken")
    out = zero.unionByName(got).groupBy(*KEY).agg(*[F.max(c).alias(c) for c in own[len(KEY):]], F.sum("n_taken").alias("taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The runs (first word, number) of a text, neighbours merged, as they stand in it; a whole text stays itself."""
    merged: list[list[int]] = []
    for at, n in sorted(runs):
        if merged and merged[-1][1] == at:
            merged[-1][1] += n
        else:
            merged.append([at, at + n])
    spans = [m.span() for m in re.finditer(WORD, text)]
    if merged == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)


def cut_all(texts: pa.Array, runs: pa.Array, rows: int = 500) -> pa.Array:
    """cut_words over a batch, `rows` at a time."""
    out = []
    for at in range(0, len(texts), rows):
        own = zip(texts.slice(at, rows).to_pylist(), runs.slice(at, rows).to_pylist())
        out.append(pa.array([cut_words(t, [(r["from_word"], r["n_taken"]) for r in rs]) for t, rs in own], pa.string()))
    release_memory()
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus: for each pass over a document a row with the words that the mix takes.

    All columns of docs come along; text holds the taken words (a document
    taken whole stays as it was) and chars_col, if there, its length.
    """
    sizes = sizes_of(docs, id_col, text_col, source_col)
    plan, rows = plan_of(sizes, **options)
    got = pieces_of(rows, plan).groupBy("doc_id", "text_hash", "source_no", "copy", "pass_no").agg(F.collect_list(F.struct("from_word", "n_taken")).alias("runs_"))
    names = rows.select("source_no", "source").distinct()
    got = got.join(F.broadcast(names) if len(plan.sources) <= 100_000 else names, "source_no")
    got = got.select(F.col("doc_id").alias("i_"), F.col("text_hash").alias("h_"), F.col("source").alias("s_"), F.col("copy").alias("c_"), "runs_")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id_"), F.xxhash64(F.col(text_col)).alias("hash_"), F.col(source_col).cast("string").alias("source_"))
    on = held.id_.eqNullSafe(F.col("i_")) & (F.col("hash_") == F.col("h_")) & held.source_.eqNullSafe(F.col("s_"))
    if not sizes.filter("copy > 1").isEmpty():
        held = held.withColumn("copy_", F.row_number().over(Window.partitionBy("id_", "hash_", "source_").orderBy(F.lit(1))))
        on = on & (F.col("copy_") == F.col("c_"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return cut_all(texts, runs)

    met = held.join(got, on).select("row", cut(F.col("row").getField(text_col), F.col("runs_")).alias("cut_"))
    fields = {c: F.col("row").getField(c).alias(c) for c in docs.columns}
    fields[text_col] = F.col("cut_").alias(text_col)
    if chars_col in fields:
        fields[chars_col] = F.length("cut_").cast(docs.schema[chars_col].dataType).alias(chars_col)
    return met.select(*fields.values())
