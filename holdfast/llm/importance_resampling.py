"""Quality by importance resampling.

Two generative models over hashed n-grams (single tokens and pairs, dealt to
BUCKETS) are counted: one over documents labelled good, one over all documents.
A document's weight is the logarithm of the ratio of its probabilities under
the two; Gumbel noise, a hash of its id, is added, and the largest `keep` share
of all documents is kept: a sample without replacement by those weights.

The target model is fitted on at most TARGET_ROWS labelled documents (those
with the least hashes of their ids), so the set of their ids can be broadcast;
the raw model and the weights cover all documents. What reaches the driver are
two counts for each of BUCKETS buckets. The least kept value is found exactly
by counting digits of the ordered values, 65,536 counts a round.

`keep` None: the share of good ones among the labelled rows.

Defined results: a null or empty text has weight 0; rows with equal values stay
or go together, so repeated rows agree; documents labelled more than once count
once; without labels both models agree and only the noise decides; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stage
from holdfast.llm.order_minhash import _HASHES, _M1, _mix

BUCKETS = 16_384
TARGET_ROWS = 20_000
SMOOTHING = 1.0
SEED = 11
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def buckets_of(text: str | None) -> np.ndarray:
    found = _TOKEN.findall(text or "")
    w = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    pairs = _mix(w[:-1] * _M1 + w[1:]) if len(w) > 1 else w[:0]
    return (np.concatenate([w, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for t, good in zip(b.column(0), b.column(1)):
            got = np.bincount(buckets_of(t.as_py()), minlength=BUCKETS)
            raw += got
            if good.as_py():
                target += got
    yield pa.RecordBatch.from_arrays([pa.array([raw.tolist()], pa.list_(pa.int64())), pa.array([target.tolist()], pa.list_(pa.int64()))], names=["raw", "target"])


def models(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """log(target / raw) for each bucket. docs: doc_id, text; good: doc_id, at most TARGET_ROWS."""
    flagged = docs.join(F.broadcast(good.withColumn("good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counted = flagged.mapInArrow(_count, "raw array<bigint>, target array<bigint>").select(F.posexplode(F.arrays_zip("raw", "target")).alias("bucket", "n"))
    rows = counted.groupBy("bucket").agg(F.sum("n.raw").alias("raw"), F.sum("n.target").alias("target")).collect()  # BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(BUCKETS)
    log = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    return log(target) - log(raw)


def weighed(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, value (with noise), place: an integer in the order of value."""

    def run(batches):
        for b in batches:
            w = np.array([ratio[buckets_of(t.as_py())].sum() for t in b.column(1)], np.float64)
            u = (b.column(2).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)).astype(np.float64)
            value = w - np.log(-np.log((u + 0.5) / 2.0**53))
            bits = value.view(np.int64)
            place = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w), pa.array(value), pa.array(place)], names=["doc_id", "log_weight", "value", "place"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)).alias("r"))
    return rows.mapInArrow(run, "doc_id bigint, log_weight double, value double, place bigint")


def kth_largest(rows: DataFrame, k: int) -> int | None:
    """The k-th largest `place`, exactly: 16 bits a round, the counts of one digit at the driver."""
    if k < 1:
        return None
    low, size = -(2**63), 2**64
    left = k
    while size > 1:
        size //= 65_536
        inside = rows.filter((F.col("place") >= F.lit(low)) & (F.col("place") <= F.lit(min(low + size * 65_536 - 1, 2**63 - 1))))
        digit = F.shiftright(F.col("place"), size.bit_length() - 1).bitwiseAND(65_535)
        if size == 2**48:
            digit = digit.bitwiseXOR(F.lit(32_768).cast("bigint"))
        for d, n in sorted(((r[0], r[1]) for r in inside.groupBy(digit.alias("d")).count().collect()), reverse=True):
            if n >= left:
                low += d * size
                break
            left -= n
        else:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, log_weight, value and kept for each row of docs."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    given = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.col(quality_col) == 1).alias("good")).filter("doc_id IS NOT NULL AND good IS NOT NULL")
    if keep is None:
        share = given.agg(F.avg(F.col("good").cast("int"))).first()[0]
        keep = 1.0 if share is None else share
    good = given.filter("good").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    scored = stage(weighed(rows, models(rows, good)), "resample-values")
    n = scored.count()
    least = kth_largest(scored, int(np.ceil(keep * n)))
    kept = F.col("place") >= F.lit(least) if least is not None else F.lit(False)
    return scored.select("doc_id", "log_weight", "value", kept.alias("kept"))
