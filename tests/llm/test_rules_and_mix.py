import re
from collections import Counter

import numpy as np

from holdfast.llm import source_mixing as sm
from holdfast.llm import weak_supervision as ws
from tests.llm.helpers import ODD, docs_frame, prose

SPACE = "[ \t-\r]+"


def brute(text):
    t = text or ""
    w = [x for x in re.split(SPACE, t) if x]
    lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


TEXTS = [*ODD, "### " * 80, "A|B " * 70, "\n".join(["spam and eggs"] * 40), prose(5, 300) + " " + prose(5, 300)[:200], "a b a b a b a", "THE LOUD WORDS!! " * 30 + prose(3, 100).upper()]


def test_counts_and_verdicts_equal_brute_force(spark):
    docs = docs_frame(spark, TEXTS * 3)
    got = {r["doc_id"]: r for r in ws.judge(docs, "doc_id").collect()}
    assert len(got) == len(TEXTS) * 3
    for i, r in got.items():
        want = brute((TEXTS * 3)[i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (TEXTS * 3)[i][:40]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert got[12]["kept"] and got[14]["kept"]
    assert not any(got[i]["kept"] for i in range(len(ODD), len(ODD) + 3)) and not got[len(TEXTS) - 1]["kept"]


def test_em_finds_good_and_bad_rules():
    rng = np.random.default_rng(1)
    true, acc = rng.random(6000) < 0.8, [0.95, 0.9, 0.6, 0.85]
    votes, right, all_bad = Counter(), Counter(), []
    for y in true:
        s = 1 if y else -1
        v = tuple(int(s if rng.random() < a else 0 if rng.random() < 0.8 else -s) if rng.random() < 0.9 else 0 for a in acc)
        votes[v] += 1
        right[v] += bool(y)
        all_bad.append((v, y))
    rates, share = ws.estimate(sorted(votes.items()))
    assert abs(share - 0.8) < 0.06
    assert ws.weight(rates[0], -1) < ws.weight(rates[2], -1) < 0 < ws.weight(rates[2], 1) < ws.weight(rates[0], 1)
    assert np.mean([(ws.posterior(v, rates, share) >= 0.5) == y for v, y in all_bad]) > 0.97
    assert ws.estimate([]) == ([], 0.5)


def junk_and(noisy, junk_share, noisy_share, total=100_000):
    """Two kinds of junk with two witnesses each, and a rule whose bad votes fall on all documents alike."""
    votes = Counter()
    for kind, share in (((-1, -1, 1, 1, 1), 0.6 * junk_share), ((1, 1, -1, -1, 1), 0.4 * junk_share), ((1, 1, 1, 1, 1), 1 - junk_share)):
        for n, part in ((-1, noisy_share), (1, 1 - noisy_share)):
            votes[(*kind, n if noisy else 1)] += round(total * share * part)
    return votes


def test_lone_bad_vote_of_a_noisy_rule_is_outvoted():
    for junk in (0.01, 0.09, 0.11, 0.2, 0.33):
        for noise in (0.002, 0.01, 0.05, 0.2):
            votes = junk_and(True, junk, noise)
            rates, share = ws.estimate(sorted(votes.items()))
            says = {v: ws.posterior(v, rates, share) for v in votes}
            assert says[(1, 1, 1, 1, 1, -1)] > 0.5, (junk, noise, says)
            assert says[(1, 1, 1, 1, 1, 1)] > 0.9, (junk, noise, says)
            assert all(p < 0.1 for v, p in says.items() if min(v[:5]) < 0), (junk, noise, says)
            assert abs(share - (1 - junk)) < 0.05


def test_how_common_a_kind_of_junk_is_does_not_save_it():
    for junk in (0.001, 0.01, 0.09, 0.099, 0.109, 0.11, 0.154, 0.2, 0.254, 0.33):
        votes = junk_and(False, junk, 0.0)
        rates, share = ws.estimate(sorted((v, n) for v, n in votes.items() if n))
        assert all((ws.posterior(v, rates, share) < 0.1) == (min(v) < 0) for v in votes), junk


def test_verdict_is_the_posterior_of_the_votes(spark):
    """quality by Bayes' rule from votes counted here, with the rates that the estimate gives for all rows."""
    docs = docs_frame(spark, TEXTS * 3 + ["$$$ ".join(prose(40 + i, 120).split()) for i in range(9)])
    rules = ws.rules()
    rows = ws.features(docs, "doc_id").select("doc_id", *[v.alias(k) for k, v in rules.items()]).collect()
    votes = {r["doc_id"]: tuple(r[k] for k in rules) for r in rows}
    rates, share = ws.estimate(sorted(Counter(votes.values()).items()))
    for r in ws.judge(docs, "doc_id").collect():
        odds = share / (1 - share)
        for v, rate in zip(votes[r["doc_id"]], rates):
            odds *= rate[1][v] / rate[0][v] if v else 1
        assert abs(r["quality"] - odds / (1 + odds)) < 1e-9
        assert r["kept"] == (not r["base_failed"] and odds >= 1)


def test_keep_good_returns_rows_as_they_were(spark):
    docs = docs_frame(spark, TEXTS)
    docs = docs.unionByName(docs.filter("doc_id = 12"))
    kept = ws.keep_good(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids.count(12) == 2 and 0 not in ids and 1 not in ids
    assert ws.keep_good(docs.limit(0)).count() == 0


def slow_fill(sizes, weights, share=1.5, most=2.0):
    low, high = 0.0, 1e12
    for _ in range(400):
        mid = (low + high) / 2
        if sum(min(most * s, w * mid) for s, w in zip(sizes, weights)) < share * sum(sizes):
            low = mid
        else:
            high = mid
    return [min(most * s, w * high) for s, w in zip(sizes, weights)]


def test_targets_are_filled_as_water():
    for sizes in ([100, 200, 50, 7], [10_000, 1, 1, 1], [5], [0, 10, 0, 3], [3, 3, 3]):
        w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        assert np.allclose(sm.fill(sizes, w), slow_fill(sizes, w), atol=1e-3)
    assert sm.fill([], []) == []


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 100, 1023, 4096, 5000):
        k = np.full(n, 987654321)
        assert sorted(sm.permute(np.arange(n), np.full(n, n), k)) == list(range(n))
        assert (sm.place_of(sm.permute(np.arange(n), np.full(n, n), k), np.full(n, n), k) == np.arange(n)).all()


def test_shards_take_exactly_the_slots():
    c = sm.shard_counts([1000, 0, 37, 5000], 64)
    assert c.sum(axis=0).tolist() == [1000, 0, 37, 5000] and c.shape == (64, 4)
    assert max(c.sum(axis=1)) - min(c.sum(axis=1)) <= 1


def test_mix_takes_the_targets(spark):
    texts = [prose(i, 20 + 37 * (i % 23)) for i in range(120)] + ODD
    sources = ["hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None for i in range(len(texts))]
    docs = docs_frame(spark, texts, sources)
    docs = docs.unionByName(docs.filter("doc_id in (0, 5)"))
    rows = sm.mix(docs, block=16).collect()
    assert len(rows) == len(texts) + 2
    again = {(r["doc_id"], r["taken"]) for r in sm.mix(docs.repartition(3), block=16).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    size, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len([x for x in re.split(SPACE, texts[r["doc_id"]] or "") if x])
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = slow_fill([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])
    for s, t in zip(order, want):
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)
        assert all(r["source_size"] == size[s] and abs(r["target"] - t) < 1e-3 for r in rows if r["source"] == s)


def test_plan_takes_the_same_time_for_any_number_of_words():
    import time

    seconds = []
    for n in (10**8, 10**10, 10**12, 10**14):
        at = time.time()
        plan = sm.Plan([("a", n + 17), ("b", 3 * n + 5), (None, n // 7 + 1)])
        seconds.append(time.time() - at)
        for words, slots, last, size, blocks in zip(plan.words, plan.slots, plan.last, plan.sizes, plan.blocks):
            short = size - (blocks - 1) * plan.block
            assert (slots - 1) * plan.block + last >= words >= (slots - 1) * plan.block + last - (slots // blocks + 1) * (plan.block - short)
    assert max(seconds) < 2


def test_mix_with_a_larger_share(spark):
    """Documents up to five times: each pass has its own permutation, and the targets are met."""
    texts = [prose(i, 20 + 7 * (i % 23)) for i in range(60)]
    rows = sm.mix(docs_frame(spark, texts), block=16, share=3.0, most=5.0).collect()
    size, taken = Counter(), Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 5 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    order = sorted(size)
    want = slow_fill([size[s] for s in order], [3, 1, 2], 3.0, 5.0)
    assert all(abs(taken[s] - t) <= 1 for s, t in zip(order, want))


def test_mixed_documents_hold_what_the_mix_takes(spark):
    texts = [prose(i, 20 + 37 * (i % 23)) for i in range(60)] + [None, "", " lead and trail "]
    docs = docs_frame(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 7"))
    out = sm.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    words, taken = Counter(), Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and r["h"] == "x"
    for r in sm.mix(docs, block=16).collect():
        taken[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in taken.items() if v} == dict(words)
    assert sm.mix(docs.limit(0)).count() == 0 and sm.mixed_documents(docs.limit(0)).count() == 0


def test_cut_words():
    assert sm.cut_words(" a  b c ", [(0, 2), (2, 1)]) == " a  b c "
    assert sm.cut_words("a b c d e", [(3, 1), (0, 2)]) == "a b\nd"
