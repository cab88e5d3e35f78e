import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash

from holdfast.llm import imatch as im
from holdfast.llm import order_minhash as om
from tests.llm.helpers import ODD, docs_frame, prose


def edit(text, seed, share):
    r, w = random.Random(seed), text.split()
    for _ in range(int(len(w) * share)):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice([[], ["new" + str(r.random())], [w[i], "put"]])
    return " ".join(w)


def corpus():
    base = [prose(100 + i, 60 + 30 * i) for i in range(12)]
    passage = prose(999, 40)
    out = list(ODD)
    for i, t in enumerate(base):
        out.append(t)
        out += [edit(t, 10 * i + j, 0.005 * (j + 1)) for j in range(6)]
    out += [prose(500 + i, 80) + " " + passage for i in range(30)]
    out += [edit(base[0], 1000 + i, 0.01) for i in range(60)]
    return out + ["one two three", "one two three", "one two four", "### ***", "### ***"]


def edit_similarity(a, b):
    """1 - (insertions + deletions) / words of both, by the full table of longest common subsequences, row by row."""
    if 3 * min(len(a), len(b)) < 2 * max(len(a), len(b)) or not a or not b:
        return 0.0  # below 0.8 by the numbers of words alone
    ids = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    x, y = np.array([ids[w] for w in a]), [ids[w] for w in b]
    row = np.zeros(len(x) + 1, int)
    for w in y:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (x == w)))
    return 2 * int(row[-1]) / (len(a) + len(b))


def brute(texts):
    w = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or edit_similarity(w[j], w[i]) >= 0.8 - 1e-9:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = docs_frame(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id in (2, 20)"))
    got = om.classes(docs).collect()
    want = brute(texts)
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["class_id"] == want[r["doc_id"]], r["doc_id"]
        assert r["kept"] == (r["doc_id"] == r["class_id"])
    kept = om.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_small_tables(spark):
    assert om.classes(docs_frame(spark, ["a"]).limit(0)).count() == 0
    assert om.classes(docs_frame(spark, ["a b c d e f g"])).first()["class_id"] == 0
    no_id = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (5, "x y z"), (None, None)], "doc_id bigint, text string")
    assert sorted((r["class_id"] is None, r["class_id"]) for r in om.classes(no_id).collect())[:3] == [(False, 5)] * 3


def test_chains_of_copies(spark):
    """Each text is a copy of the one before it: far ones are linked through those between."""
    texts = [prose(77, 400, 4000)]
    for i in range(40):
        texts.append(edit(texts[-1], 900 + i, 0.012))
    texts += [prose(78 + i, 200, 4000) for i in range(5)]
    want = brute(texts)
    assert len(set(want)) < 12
    got = {r["doc_id"]: r["class_id"] for r in om.classes(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_short_texts(spark):
    """Few edits leave no k-mer of a short text: all of its links are found all the same."""
    texts = []
    for n in range(2, 27):
        for i in range(4):
            w = [f"w{n}x{i}x{j}" for j in range(n)]
            e = list(w)
            for _ in range(n // 5 if i else 1):
                e[random.Random(n * 7 + i).randrange(len(e))] = f"e{n}x{i}"
            texts += [" ".join(w), " ".join(e) if i else " ".join([*w, "put"])]
    texts += ["The, same words!", "the same words"]
    texts += [f"the same eight words before all of them {i}" for i in range(40)]
    want = brute(texts)
    got = {r["doc_id"]: r["class_id"] for r in om.classes(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert want[201] == 200 and len(set(want)) < 150


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    label = {}

    def find(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    got = {r["node"]: r["label"] for r in om.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(i, i) == find(i) for i in label)


def test_matches_in_band():
    r = random.Random(5)
    for i in range(400):
        size, letters = (12, 4) if i < 300 else (400, 60)
        a = [r.randrange(letters) for _ in range(r.randrange(size))]
        b = [x for x in a if r.random() < 0.9] if i % 2 else [r.randrange(letters) for _ in range(r.randrange(size))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                t[x + 1][y + 1] = t[x][y] + 1 if a[x] == b[y] else max(t[x][y + 1], t[x + 1][y])
        want, total = t[-1][-1], len(a) + len(b)
        assert om.matched(a, b, total) == want
        if a and b:
            assert om.matched(a, b, total - 2 * want) == want, "an alignment of so few edits stays within as many diagonals"
            _, got = om.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
            sim = 2 * want / total
            assert got == pytest.approx(sim) if sim >= 0.8 else got is None


def test_order_counts():
    a = prose(1, 200, 5000).split()
    swapped = a[100:] + a[:100]
    aligned, sim = om.similarity(om.word_hashes(a), om.word_hashes(swapped))
    assert aligned and sim is None


def test_edited_texts_are_found(spark):
    """Pairs at every similarity from the limit up, by an edit distance of its own; words changed here and there, the worst case for k-mers."""
    r, texts = random.Random(11), []
    for i in range(160):
        w = [f"v{r.randrange(30000)}" for _ in range(r.choice([40, 90, 250, 600]))]
        share = 0.19 * (i % 8 + 1) / 8
        edited = [f"e{r.randrange(30000)}" if r.random() < share else x for x in w]
        texts += [" ".join(w), " ".join(edited)]
    got = {x["doc_id"]: x["class_id"] for x in om.classes(docs_frame(spark, texts)).collect()}
    sims = {i: edit_similarity(texts[i].split(), texts[i + 1].split()) for i in range(0, 320, 2)}
    for least, share in ((0.95, 0.99), (0.9, 0.97), (0.88, 0.9), (0.8, 0.7)):
        pairs = [i for i, x in sims.items() if x >= least]
        assert len(pairs) > 30 and sum(got[i] == got[i + 1] for i in pairs) >= share * len(pairs), least
    assert len({got[i] for i in range(0, 320, 2)}) == 160


def test_texts_around_one_passage(spark):
    """More than SMALL texts share half of themselves; two pairs among them are copies, the rest stays apart."""
    passage = prose(999, 120, 5000)
    texts = [passage + " " + prose(500 + i, 120, 60000) for i in range(120)]
    texts += [edit(texts[3], 5, 0.08), edit(texts[70], 6, 0.08)]
    want = brute(texts)
    assert len(set(want)) == 120
    _, tested, _ = om.links(docs_frame(spark, texts))
    rows = tested.agg({"sim": "count", "*": "count"}).first()
    assert rows[0] >= 2 and rows[1] < 121 * 120 // 4
    got = {r["doc_id"]: r["class_id"] for r in om.classes(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_fingerprints_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(im, "PER_RANGE", 7)
    texts = [prose(i % 40, 30 + 11 * (i % 40), 2000) for i in range(60)] + ODD
    docs = docs_frame(spark, texts, start=5)
    got = {r["doc_id"]: r for r in im.compare_neighbours(docs).collect()}
    assert len(got) == len(texts)
    ids = sorted(got, reverse=True)
    prints = {}
    for k, i in enumerate(ids):
        own, nxt = texts[i - 5] or "", texts[ids[(k + 1) % len(ids)] - 5] or ""
        n = len(own) // 3
        edited = own[: len(own) - n] + nxt[:n]
        r = got[i]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert prints.setdefault(own, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert r["near_edited"] == 1 or edited != own
        assert (r["near_next"] == 1) == (own == nxt) or r["fingerprint"] == got[ids[(k + 1) % len(ids)]]["fingerprint"]
    again = {r["fingerprint"] for r in im.fingerprint(docs, im.lexicon(docs)).collect() if not r["fingerprint"].startswith("text:")}
    assert again == {p for p in prints.values() if not p.startswith("text:")}
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > 0.25 and mean("near_edited") > 3 * mean("near_next")


def test_large_group_of_copies_keeps_its_terms(spark):
    """A third of the rows are copies of one text: its terms stay in the lexicon, and near copies stay alike."""
    other = [" ".join(random.Random(i).choices([f"t{j}" for j in range(2000)], k=120)) for i in range(80)]
    hot = other[0]
    docs = docs_frame(spark, other + [hot] * 40)
    assert {r["term"] for r in im.lexicon(docs).collect()} == {r["term"] for r in im.lexicon(docs_frame(spark, other)).collect()}
    got = [r for r in im.compare_neighbours(docs).collect() if r["doc_id"] == 0 or r["doc_id"] >= 80]
    assert not any(r["fingerprint"].startswith("text:") for r in got)
    at = {r["doc_id"]: r for r in got}
    assert at[80]["near_next"] < 0.5 and 0.3 < at[80]["near_edited"] <= 1
    assert at[0]["fingerprint"] == at[80]["fingerprint"]


def test_fingerprints_of_few_rows(spark):
    assert im.compare_neighbours(docs_frame(spark, ["a"]).limit(0)).count() == 0
    one = im.compare_neighbours(docs_frame(spark, ["abcdef"])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one[0]["near_next"] == 1
    two = docs_frame(spark, ["abcdef"])
    null = spark.createDataFrame([(None, "xyz", "en", "s", 3, "", "", "", "", "")], two.schema)
    got = {r["doc_id"]: r["edited_sha256"] for r in im.compare_neighbours(two.unionByName(two).unionByName(null)).collect()}
    assert got[None] == hashlib.sha256(b"xya").hexdigest()
    assert len(got) == 2


def term_set(text):
    return set(regex.split(r"[^\p{L}\p{N}]+", (text or "").lower())) - {""}


def band_of(texts):
    different = set(t or "" for t in texts)
    df = Counter(x for t in different for x in term_set(t))
    return {x for x, n in df.items() if max(2, im.LOW * len(different)) <= n <= max(2, im.HIGH * len(different))}


def prints(texts, band):
    """Hashes of each text by the definition: sorted hashes of its terms in the band, a hash for each subset."""
    out = []
    for t in texts:
        tids = sorted(signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in term_set(t) & band)
        hashes = []
        for skip, parts, used in im.RATES:
            for j in range(used):
                own = [x for x in tids if (x % 2**64 >> skip) % parts == j]
                h = 42
                for x in own:
                    h = xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), h)
                hashes.append(h & 0xFFFFFFFF if own else None)
        out.append(hashes)
    return out


def signed(x):
    return x - 2**64 if x >> 63 else x


def alike(a, b):
    best, at = 0.0, 0
    for _, _, used in im.RATES:
        pairs = list(zip(a[at : at + used], b[at : at + used]))
        met = sum(x is not None or y is not None for x, y in pairs)
        best = max(best, sum(x is not None and x == y for x, y in pairs) / max(met, im.ENOUGH))
        at += used
    return best


@pytest.mark.parametrize("ids", ["plain", "clustered", "extreme"])
def test_fingerprints_equal_brute_force(spark, monkeypatch, ids):
    """Hashes, likeness and neighbours by the definition, for ids that lie close, far apart or at both ends of bigint, and null ones."""
    monkeypatch.setattr(im, "PER_RANGE", 9)
    texts = [prose(i % 30, 30 + 9 * (i % 30), 900) for i in range(40)] + ODD + [None, "a"]
    n = len(texts)
    at = {"plain": list(range(n)), "clustered": [*range(n - 1), 2**60], "extreme": [-(2**63), 2**63 - 1, *range(n - 4), None, None]}[ids]
    docs = spark.createDataFrame(list(zip(at, texts)), "doc_id bigint, text string")
    got = Counter()
    for r in im.compare_neighbours(docs).collect():
        got[(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9))] += 1
    hash_of = lambda t: signed(xxhash.xxh64_intdigest((t or "").encode(), 42))
    order = sorted(range(n), key=lambda i: (at[i] is None, -(at[i] or 0), hash_of(texts[i])))
    own = [t or "" for t in texts]
    edited = [None] * n
    for k, i in enumerate(order):
        third = len(own[i]) // 3
        edited[i] = own[i][: len(own[i]) - third] + own[order[(k + 1) % n]][:third]
    plain, changed = prints(texts, band_of(texts)), prints(edited, band_of(texts))
    show = lambda h, t: "".join("-" if x is None else f"{x:08x}" for x in h) if any(x is not None for x in h) else "text:" + hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for k, i in enumerate(order):
        j = order[(k + 1) % n]
        near_e = 1.0 if edited[i] == own[i] else alike(plain[i], changed[i])
        near_n = 1.0 if own[j] == own[i] else alike(plain[i], plain[j])
        want[(at[i], len(own[i]), hashlib.sha256(edited[i].encode()).hexdigest(), show(plain[i], own[i]), show(changed[i], edited[i]), round(near_e, 9), round(near_n, 9))] += 1
    assert got == want
    one = {r["fingerprint"] for r in im.fingerprint(docs, im.lexicon(docs)).collect()}
    assert one == {show(h, t) for h, t in zip(plain, own)}


@pytest.mark.parametrize("text", [None, "", "x"])
def test_words_of_odd_texts(text):
    assert len(om.labelled(om.word_hashes(om.words_of(text)))) == (1 if text else 0)
