import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from holdfast.llm import byte_bpe, secret_scan, source_mixing
from tests.conftest import SF
from tests.llm.helpers import prose
from tests.llm.test_near_and_prints import brute, edit
from tests.llm.test_rules_and_mix import brute as counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    clean = [prose(i, 90 + 7 * i, 3000) for i in range(30)]
    texts = clean + [edit(clean[i], i, 0.01) for i in range(10)] + [clean[3], clean[4]] + ["### x " * 60, None, "", "short"]
    texts[5] += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, str(tmp_path)).collect())

    good = [i for i, t in enumerate(texts) if counts(t)[0] >= 50 and counts(t)[2] == 0]
    label = brute([texts[i] for i in good])
    stay = sorted({good[k] for k in label})
    masked = {i: texts[i].replace("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", secret_scan.MASK) for i in stay}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in masked.items()], SCHEMA)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks("byte_bpe_50k.tiktoken"), special_tokens={})
    want = []
    for r in source_mixing.mixed_documents(docs).collect():
        ids = enc.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert got == sorted(want)
    assert {i for i, *_ in got} <= set(stay) and secret_scan.MASK in masked[5]


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in cp.STAGES[:-1]:
        docs = f(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.limit(60)
    assert 4 <= len(cp.STAGES) <= 5
