"""Quality rules by weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on a document. How far each rule
can be trusted is not set by hand: expectation-maximisation over the votes of
all documents estimates how each rule votes on good and on bad ones, and the share of good
documents, and a document is kept if its posterior probability of being good
is at least KEEP_AT. Documents with equal votes are one case, so the estimate
needs only the count of each vote pattern: at most 3 ** rules (6561) rows,
however large the corpus.

Base rules come first: a document that fails them is never kept.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows each give a row; a document on which all rules abstain gets the
share of good documents as its probability; an empty table gives no rows;
extra columns are ignored (keep_good returns them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stage, words

KEEP_AT = 0.5
MIN_WORDS = 50
#: Bounds on what EM may believe of the corpus, and how much of its start it keeps.
SHARE = (0.05, 0.99)
PRIOR = 0.02
#: How probably good a document without a bad vote is at the start, and at least while rates are counted.
CLEAN = 0.95
ROUNDS = 100
SYMBOLS = "[^#*$%&|<>]+"


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """name -> vote over the columns of features()."""
    n, c = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": _vote(F.col("n_symbols") * 100 <= n * 2, F.col("n_symbols") * 10 > n),
        "dup_lines": _vote(F.col("n_dup_lines") * 20 <= F.col("n_lines"), (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3) & (F.col("n_dup_lines") >= 3)),
        "repeats": _vote(F.col("n_repeat_words") * 10 <= n, F.col("n_repeat_words") * 10 > n * 3),
        "word_length": _vote((c >= n * 3) & (c <= n * 12), (c < n * 2) | (c > n * 15)),
        "capitals": _vote(F.col("n_upper") * 10 <= c, F.col("n_upper") * 10 > c * 4),
        "letters": _vote(F.col("n_letters") * 10 >= c * 8, F.col("n_letters") * 10 < c * 7),
        "wordy": _vote(F.col("n_wordy") * 10 >= n * 9, F.col("n_wordy") * 10 < n * 8),
        "short_lines": _vote(n >= F.col("n_lines") * 5, n < F.col("n_lines") * 2),
    }


def features(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """`keep` columns and the counts of each row's whole text.

    n_repeat_words finds repeated windows by sorting (hash of the three words,
    place) inside the row: n log n in the words, no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(*keep, text.alias("_text"), words(F.col(text_col)).alias("_w"), F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"))
    places = F.when(F.size("_w") >= 3, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))
    two = one.select(*keep, "_text", "_w", "_lines", F.sort_array(F.transform(places, window)).alias("_s"))
    again = F.filter("_s", lambda x, j: (x.h == F.get("_s", j + 1).h) | ((j > 0) & (x.h == F.get("_s", j - 1).h)))
    three = two.select(*keep, "_text", "_w", "_lines", F.transform(again, lambda x: x.i).alias("_r"))
    covered = F.array_distinct(F.flatten(F.transform("_r", lambda i: F.array(i, i + 1, i + 2))))
    return three.select(
        *keep,
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(covered).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("bigint").alias("n_upper"),
        F.length(F.regexp_replace("_text", r"\P{L}+", "")).cast("bigint").alias("n_letters"),
        F.size(F.filter("_w", lambda x: F.rlike(x, F.lit(r"\p{L}")))).cast("bigint").alias("n_wordy"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[list[dict[int, dict[int, float]]], float]:
    """rates[j][y][v]: how often rule j, if it votes, votes v on good (y = 1) and bad (y = 0) documents; and the share of good ones.

    Abstaining says nothing.

    Starts from the rules' intent: a document that any rule calls bad is
    probably bad. Each round expects every pattern's probability of being good
    and counts the rates again; PRIOR of the first counts is mixed in, and a
    rule may not call good documents bad more often than bad ones, so the
    classes cannot change places. False alarms are counted like all else: a
    rule whose bad votes others back (symbol junk has two witnesses among
    rules(); repeats may stand alone, and the base rules take them) ends with few, one that mostly stands alone with many,
    and its lone vote is outvoted. A document that no rule calls bad counts as
    good to CLEAN at least in each round: the bad class holds several kinds of
    junk, expects several bad votes, and would else fill up with documents that
    have none.
    """
    if not patterns:
        return [], 0.5
    m, total = len(patterns[0][0]), sum(n for _, n in patterns)
    good = [1 - CLEAN if -1 in votes else CLEAN for votes, _ in patterns]
    rates, share, first = [], 0.5, None
    for _ in range(rounds):
        counts = [{y: dict.fromkeys((-1, 1), 1e-2) for y in (0, 1)} for _ in range(m)]
        for (votes, n), p in zip(patterns, good):
            for j, v in enumerate(votes):
                if v:
                    counts[j][1][v] += n * p
                    counts[j][0][v] += n * (1 - p)
        first = first or counts
        new = []
        for c, f in zip(counts, first):
            mixed = {y: {v: c[y][v] + PRIOR * f[y][v] for v in c[y]} for y in c}
            r = {y: {v: x / sum(mixed[y].values()) for v, x in mixed[y].items()} for y in mixed}
            alarm = min(r[1][-1], r[0][-1])
            new.append({0: r[0], 1: {-1: alarm, 1: 1 - alarm}})
        new_share = min(max(sum(n * p for (_, n), p in zip(patterns, good)) / total, SHARE[0]), SHARE[1])
        moved = abs(new_share - share) + max((abs(a[y][v] - b[y][v]) for a, b in zip(new, rates) for y in a for v in a[y]), default=1.0)
        rates, share = new, new_share
        good = [max(posterior(votes, rates, share), 0.0 if -1 in votes else CLEAN) for votes, _ in patterns]
        if moved < 1e-9:
            break
    return rates, share


def weight(rate: dict[int, dict[int, float]], vote: int) -> float:
    """What a vote adds to the log-odds of being good."""
    return math.log(rate[1][vote] / rate[0][vote]) if vote else 0.0


def posterior(votes, rates, share) -> float:
    x = math.log(share / (1 - share)) + sum(weight(r, v) for r, v in zip(rates, votes))
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def judge(docs: DataFrame, *keep: str, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """`keep` columns, the counts, base_failed, quality (posterior) and kept.

    The counts are written to the shared folder once: the votes are counted
    over them for EM and then judged, and no text is read twice.
    """
    votes = rules()
    held = stage(features(docs, *keep, text_col=text_col).withColumn("base_failed", base_failed()), "quality")
    counted = held.groupBy(*[v.alias(k) for k, v in votes.items()]).count().collect()  # at most 3 ** rules rows
    rates, share = estimate(sorted((tuple(r[: len(votes)]), r["count"]) for r in counted))
    x = F.lit(math.log(share / (1 - share)))
    for v, r in zip(votes.values(), rates):
        x = x + F.when(v < 0, weight(r, -1)).when(v > 0, weight(r, 1)).otherwise(weight(r, 0))
    scored = held.withColumn("quality", 1 / (1 + F.exp(-x)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns as they were.

    A row travels as one struct, so its column names cannot clash with the counts.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return judge(held, "row").filter("kept").select("row.*")
