"""Token counts of whole texts by batch encoding in Arrow functions.

The function returns lengths only. Inside an Arrow batch, texts longer than
CHUNK_BYTES are cut at safe boundaries (one space between two word characters,
where no pre-token and no added token can span the cut), and the pieces are
encoded in batches balanced by bytes, so one long text neither blows up a
batch nor stalls one.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated
rows each give a row; a long text without a safe boundary is encoded whole;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 16_384
BATCH_BYTES = 262_144
_SAFE = re.compile(r"\w \w")


def _place(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def _counter(name: str):
    """(function from a list of strings to their lengths, may texts be cut)."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=_place(name))
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(_place(name))
    t.no_truncation()
    t.no_padding()
    cut = "ByteLevel" in str(t.pre_tokenizer) and t.normalizer is None
    cut = cut and not any(re.search(r"\s", x.content) or x.lstrip or x.rstrip for x in t.get_added_tokens_decoder().values())
    return (lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]), cut


def split_safely(text: str, size: int = CHUNK_BYTES) -> list[str]:
    """Pieces of about `size` bytes that encode as they do in the whole."""
    out, at = [], 0
    size = size if text.isascii() else max(size // 4, 1)
    while len(text) - at > size:
        m = _SAFE.search(text, at + size - 1)
        if not m:
            break
        out.append(text[at : m.start() + 1])
        at = m.start() + 1
    out.append(text[at:])
    return out


def lengths(texts: list[str | None], name: str) -> list[int]:
    count, cut = _counter(name)
    pieces, owner = [], []
    for i, t in enumerate(texts):
        for p in split_safely(t) if cut and t else [t] if t else []:
            pieces.append(p)
            owner.append(i)
    out = [0] * len(texts)
    batch, size = [], 0
    held = [len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in pieces]
    for k in [*sorted(range(len(pieces)), key=held.__getitem__), None]:
        if k is None or size + held[k] > BATCH_BYTES and batch:
            for j, n in zip(batch, count([pieces[j] for j in batch]) if batch else []):
                out[owner[j]] += n
            batch, size = [], 0
        if k is not None:
            batch.append(k)
            size += held[k]
    return out


def token_count(text: Column, name: str) -> Column:
    @F.arrow_udf("bigint")
    def n_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(lengths(texts.to_pylist(), name), pa.int64())

    return n_tokens(text)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), token_count(F.col("text"), tokenizer).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
