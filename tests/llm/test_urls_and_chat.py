import hashlib
import re

from pyspark.sql import functions as F

from holdfast.llm import chat_format as cf
from holdfast.llm import url_filter as uf

URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "HTTP://A.COM/x", "http://example.com/en/1", "http://www.example.com/en/1",
    "http://a.www.example.com/en/", "http://notexample.com/en/1", "http://example.com/EN/1", "http://x.net/es/9#top", "http://x.net/fr?q", "http://x.net/fr/",
    "https://spam-farm.example.org/en/728?utm_source=feed", "http://a.org/best-casino/?x", "http://a.org/p?PHPSESSID=1", "http://a.org/p?print=1", "http://a.org/p?print=12",
    "http://example.com?x=/en/", "http://example.com:80/en/", "ftp://user@example.com/en/a", "http://K.com/", "http://x.com/a\nb", "http://a.net/es/://b.com/",
]


def brute(url):
    u = url or ""
    host = path = ""
    if "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in uf.SITES:
        h, s, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(r.name) > len(best.name)):
            best = r
    if best:
        return host, path, best.name, best.verdict
    return host, path, None, "block" if any(re.search(r.pattern, u, re.A) for r in uf.PATTERNS) else "allow"


def test_verdicts_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "r", "t") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "r", "t"), (None, None, None, None, None)], "page_id bigint, url string, host string, rule string, token string")
    for bound in (20_000, 0):  # broadcast, then the salted shuffle
        got = uf.judge_urls(pages, broadcast_rules=bound).collect()
        assert len(got) == len(URLS) + 2
        for r in got:
            if r["page_id"] is not None:
                assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]]), URLS[r["page_id"]]
    assert uf.judge_urls(pages.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("http://a.com/en/",), ("http://b.com/",), ("http://example.com/",)], "url string")
    index = {r["rule"]: r["token"] for r in uf.rule_index(urls, [*uf.SITES, uf.Rule("any", "[0-9]{3}", "block")]).collect()}
    assert index["com/"] == "com" and index["example.com/en/"] in ("en", "example") and index["any"] == ""
    assert uf.literal_tokens(r"/ads(?:/|$)") == [] and uf.literal_tokens(r"^ads/") == ["ads"] and uf.literal_tokens("(a|b)-track-") == ["track"]


CONVS = [
    (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello </s> there"),
    (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "assistant", "first"), (2, 5, "user", "late"),
    (3, 0, "user", "<s>[INST] x [/INST]</s> <\\/s> <\\\\s> [\\INST] [ROLE] <</s>"), (3, 1, "assistant", "[OUT] [SYS] [/SYS]\n</s>[INST]"),
    (4, 0, "tool<s>", "x [/ROLE] y"), (4, 1, None, "none"), (5, None, "user", "a"), (5, 0, "assistant", "b"), (5, 0, "assistant", "b"),
    *[(6, t, ("user", "assistant")[t % 2], f"turn {t} \U0001f600") for t in range(400)], (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_what_is_read_back(spark):
    rows = spark.createDataFrame([(*r, "x", "y") for r in CONVS], "conv_id bigint, turn bigint, role string, text string, chunk string, segments string")
    chunks = cf.format_chat(rows)
    got = {r["conv_id"]: r for r in cf.digests(chunks).collect()}
    valid = {r["conv_id"]: r["valid"] for r in cf.conversations_of(chunks).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    formatted = {}
    for r in chunks.select("conv_id", "chunk", cf.text_of(F.col("segments")).alias("t")).collect():
        formatted.setdefault(r["conv_id"], []).append((r["chunk"] if r["chunk"] is not None else -1, r["t"]))
    for c in {x[0] for x in CONVS}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in CONVS if k == c))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(turns), sha(said), len(loss), sha(loss)), c
        assert g["formatted_chars"] == sum(len(t) for _, t in formatted[c])
        state = 0
        for *_, r, _ in turns:
            state = cf.MOVES.get((state, r), cf.REJECTED)
        assert g["valid"] == valid[c] == (state in cf.FINAL)
        assert sum(len(re.findall("</s>", t)) for _, t in formatted[c]) == len(turns)
    assert cf.digests(cf.format_chat(rows.limit(0))).count() == 0


def test_escape_can_be_undone(spark):
    texts = ["</s>", "<\\/s>", "<\\\\/s>", "[INST][/INST]", "plain \\ < [ ]", "<<s>", "[[OUT]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cf.escape(F.col("t")).alias("e"), cf.unescape(cf.escape(F.col("t"))).alias("b"))
    for r in df.collect():
        assert r["b"] == r["t"] and not re.search(r"</?s>|\[/?(INST|SYS|ROLE)\]|\[OUT\]", r["e"])


def test_index_finds_what_a_plain_scan_finds(spark):
    """Random rules over random URLs: fetching rules by their rarest token loses none."""
    import random
    import re

    from holdfast.llm import url_filter as uf

    r = random.Random(8)
    words = ["foo", "bar", "x", "foobar", "ads", "shop", "a1"]
    forms = ["/{}/", "[?&]{}=", "^[a-z]+://(?:[^/?#]*\\.)?{}\\.", "/{}(?:x\\.)?{}/", "{}(?:x\\.)?{}", "[/.-]{}[/.-]", "{}$", "/{}/{}", "(?:[a-z]+\\.)?{}/", "/{}(?:\\.)?{}", "(?i)[/.]{}[?/]", "{}+/", "/{}?/"]
    rules = [uf.Rule(f"r{i:02}", f.format(*[r.choice(words) for _ in range(f.count("{}"))]), "block") for i in range(6) for f in forms]
    rules = [uf.Rule(f"r{i:03}", x.pattern, "block") for i, x in enumerate(rules)]
    urls = ["http://a.net/foobar/x", None, "", "http://a.net/" + "foo/" * 20_000]
    for _ in range(300):
        urls.append("http://" + ".".join(r.choice(words) for _ in range(r.randint(1, 3))) + ".net/" + r.choice(["/", ".", "-", ""]).join(r.choice([*words, "xbar", "foox.bar"]) for _ in range(r.randint(0, 4))) + r.choice(["", "/", "?ads=1", "&x=2"]))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {x["page_id"]: (x["verdict"], x["matched"]) for x in uf.judge_urls(pages, sites=(), patterns=rules).collect()}
    for i, u in enumerate(urls):
        hits = [x.name for x in rules if re.search(x.pattern, u or "")]
        assert got[i] == (("block", min(hits)) if hits else ("allow", None)), (u or "")[:60]
