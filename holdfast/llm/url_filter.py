"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path or over the whole URL. Of the
literal tokens (ASCII letters and digits) that every match must hold, the one
that occurs in the fewest URLs is its key in the index. The tokens of a URL
fetch the rules under them, and only those rules run their expression. A rule
without such a token is filed under the empty token, which each URL has.

Host/path rules become patterns too (site_rule); the longest that fits wins.
Where none fits, the pattern rules decide: block if any matches, else allow.

Scale: rows are (URL, token); the rule side is broadcast while it has at most
BROADCAST_RULES rules (their number is known on the driver), else it joins by
shuffle with the URLs' rows of a token dealt over SALTS parts, so a token that
all URLs share does not meet in one task. The best rule per URL is a
partial aggregation.

Defined results: null or no "://": host and path empty, only rules that fit
the empty string can match; repeated rows each give a row; extra columns are
ignored; ties between rules of one length go to the smaller rule text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import LOWER, UPPER

BROADCAST_RULES = 20_000
SALTS = 32


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    verdict: str
    site: bool = False

    def tokens(self) -> list[str]:
        return literal_tokens(self.pattern)


def site_rule(name: str, verdict: str) -> Rule:
    """A rule like example.com/en/ fits the host and its subdomains and paths that start so."""
    host, slash, path = name.partition("/")
    return Rule(name, r"^(?:[^/]*\.)?" + re.escape(host.translate(str.maketrans(UPPER, LOWER))) + re.escape(slash + path), verdict, True)


#: Rules that judge a URL where no host/path rule fits.
PATTERNS = (
    Rule("link-farm", r"(?i)^[a-z]+://(?:[^/?#]*\.)?spam-farm\.", "block"),
    Rule("casino", r"(?i)[/.-]casino[/.-]", "block"),
    Rule("adult", r"(?i)[/.-]xxx[/.-]", "block"),
    Rule("session-id", r"(?i)[?&;]phpsessid=", "block"),
    Rule("print-view", r"(?i)[?&]print=1(?:&|#|$)", "block"),
)

#: The host/path rules of the registered query.
SITES = (
    site_rule("com/", "allow"),
    site_rule("example.com/en/", "block"),
    site_rule("www.example.com/en/", "allow"),
    site_rule("net/es/", "block"),
    site_rule("net/fr/", "block"),
)


def literal_tokens(pattern: str) -> list[str]:
    """Lower-cased alphanumeric runs that stand whole in every match.

    Only literals at the top level of the expression count, and a run counts
    only where characters that are not alphanumeric ASCII bound it on both sides.
    """
    tree = re._parser.parse(pattern)
    word = re.compile(r"[A-Za-z0-9]")
    found: list[str] = []
    run, bounded = "", False
    no_word = lambda c: not word.match(c)

    def close(ended: bool) -> None:
        nonlocal run
        if run and bounded and ended:
            found.append(run.lower())
        run = ""

    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            c = chr(arg)
            if no_word(c):
                close(True)
                bounded = True
            else:
                run += c
        elif kind == "IN" and all(str(o) == "LITERAL" and no_word(chr(a)) for o, a in arg):
            close(True)
            bounded = True
        elif kind == "AT":
            # an anchor: the text begins or ends here
            close(str(arg).startswith("AT_END"))
            bounded = str(arg).startswith("AT_BEGINNING")
        elif kind == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1 and _ends_in_dot(arg[2]) and bounded and not run:
            # an optional "(...\.)" after a boundary: what follows is bounded either way
            close(False)
            bounded = True
        else:
            close(False)
            bounded = False
    # at the end of the pattern, a longer run may go on in the URL
    close(False)
    return list(dict.fromkeys(found))


def _ends_in_dot(tree) -> bool:
    last = list(tree)[-1]
    if str(last[0]) == "SUBPATTERN":
        return _ends_in_dot(last[1][3])
    return str(last[0]) == "LITERAL" and last[1] == ord(".")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"))


def _rules_frame(spark: SparkSession, rules) -> DataFrame:
    rows = [(i, r.name, r.pattern, r.verdict, r.site, t) for i, r in enumerate(rules) for t in (r.tokens() or [""])]
    return spark.createDataFrame(rows, "rule_no int, rule string, pattern string, rule_verdict string, site boolean, token string")


def rule_index(urls: DataFrame, rules) -> DataFrame:
    """One row per rule: its fields and the rarest of its tokens in `urls` (a column url)."""
    spark = urls.sparkSession
    given = _rules_frame(spark, rules)
    wanted = given.select("token").distinct()
    wanted = F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted
    counts = urls.select(F.explode(tokens_of(F.coalesce("url", F.lit("")))).alias("token")).join(wanted, "token").groupBy("token").count()
    ranked = given.join(counts, "token", "left").groupBy("rule_no", "rule", "pattern", "rule_verdict", "site")
    return ranked.agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("token").alias("t"))).alias("token"))


def judge_urls(pages: DataFrame, sites=SITES, patterns=PATTERNS, default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, matched for each row of pages."""
    rules = [*sites, *patterns]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    index = rule_index(rows, rules).select("token", "rule", "pattern", "rule_verdict", "site")
    index = index.groupBy("token").agg(F.collect_list(F.struct("rule", "pattern", "rule_verdict", "site")).alias("rules"))
    parts = rows.select("page_id", "url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("place"), F.posexplode(F.array_union(F.array(F.lit("")), tokens_of(F.coalesce("url", F.lit(""))))).alias("pos", "token"))
    if len(rules) <= broadcast_rules:
        met = parts.join(F.broadcast(index), "token", "left")
    else:
        index = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = parts.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(index, ["token", "salt"], "left")
    fits = F.filter("rules", lambda r: F.when(r.site, F.rlike(F.col("place"), r.pattern)).otherwise(F.rlike(F.coalesce("url", F.lit("")), r.pattern)))
    met = met.select("page_id", "url", "pos", F.when(F.col("rules").isNotNull(), fits).alias("fit"))
    site = F.array_min(F.transform(F.filter("fit", lambda r: r.site), lambda r: F.struct((-F.length(r.rule)).alias("less"), r.rule.alias("rule"), r.rule_verdict.alias("verdict"))))
    found = F.array_min(F.transform(F.filter("fit", lambda r: ~r.site), lambda r: F.struct((r.rule_verdict != "block").alias("weak"), r.rule.alias("rule"), r.rule_verdict.alias("verdict"))))
    best = met.groupBy("page_id", "url").agg(F.min(site).alias("site"), F.min(found).alias("found"), F.sum((F.col("pos") == 0).cast("int")).alias("n"))
    best = best.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return best.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", "found.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("found.rule")).alias("matched"),
    )
