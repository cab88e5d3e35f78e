import hashlib

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from holdfast.llm import byte_bpe, token_counts
from tests.llm.helpers import ODD, docs_frame


def _tiktoken():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks("byte_bpe_50k.tiktoken"), special_tokens={})


def test_bpe_equals_the_library(spark):
    docs = docs_frame(spark, ODD)
    docs = docs.unionByName(docs.filter("doc_id = 3"))
    enc, got = _tiktoken(), byte_bpe.encode_documents(docs).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        text = ODD[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids), repr(text[:60])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_segments_and_emptied_cache(monkeypatch):
    monkeypatch.setattr(byte_bpe, "SEGMENT", 7)
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(byte_bpe, "KEEP_WORDS", 3)
    import regex

    enc = _tiktoken()
    got = list(byte_bpe._digests(ODD[-4:], "byte_bpe_50k.tiktoken", regex.compile(P.PATTERN)))
    for text, (n, ids, dec) in zip(ODD[-4:], got):
        want = enc.encode_ordinary(text)
        assert (n, ids, dec) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_ids_and_empty_table(spark):
    enc = _tiktoken()
    assert byte_bpe.encode_ids(["hello world", ""]) == [enc.encode_ordinary("hello world"), []]
    assert byte_bpe.encode_documents(docs_frame(spark, ["a"]).limit(0)).count() == 0


def test_counts_equal_the_library(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_counts.count_tokens(docs_frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = ODD[r["doc_id"]] or ""
        n = len(t.encode(text, add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024), repr(text[:40])
    assert token_counts.count_tokens(docs_frame(spark, ["a"]).limit(0)).count() == 0


def test_long_texts_are_cut_where_nothing_spans():
    text = " ".join(x or "" for x in ODD)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for size in (5, 50, 1000):
        parts = token_counts.split_safely(text, size)
        assert "".join(parts) == text and len(parts) > 3
        assert sum(len(t.encode(p, add_special_tokens=False)) for p in parts) == len(t.encode(text, add_special_tokens=False))


def test_sentencepiece_counts():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert token_counts.lengths(["hello world", None, ""], "piece_bpe_32k.model") == [len(m.encode("hello world")), 0, 0]
