"""Byte-level BPE encoding and decoding by recursive queries in DuckDB.

Each partition cuts its texts into the pattern's matches and encodes every
distinct match once, in an in-memory DuckDB: token-position rows join the merge
table, each word's leftmost pair of minimum rank is contracted, and the query
recurs until no pair of any word is in the table. An ordered aggregation over
the token rows decodes the ids to bytes again.

Memory is bounded: texts are handled in segments of SEGMENT matches, AT_ONCE
words in a query; beyond CACHE_WORDS, and when a task ends, the table of encoded
words keeps the KEEP_WORDS that came first. A match of more
than LONG_BYTES bytes (a run of letters without a space, say) would need as
many recursions as it has bytes; the same contraction rule is applied to it
with a heap instead.

Defined results: a null text is the empty text (no tokens); repeated rows each
give a row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import release_memory

SEGMENT = 100_000
CACHE_WORDS = 450_000
KEEP_WORDS = 200_000
AT_ONCE = 50_000
ROWS = 1000
LONG_BYTES = 256

#: Rows (word, tokens); positions are unnested, joined with the merge table,
#: and the leftmost of the lowest rank is contracted.
ENCODE = """
WITH RECURSIVE state AS (
    SELECT w, toks, 0 AS turn FROM start
    UNION ALL
    SELECT w, list_concat(list_append(toks[:spot], rank), toks[spot + 3:]), turn + 1
    FROM (
        SELECT p.w, any_value(p.toks) AS toks, any_value(p.turn) AS turn,
               (min((m.rank::BIGINT << 20) | p.pos) & 1048575)::INT AS spot,
               (min((m.rank::BIGINT << 20) | p.pos) >> 20)::INT AS rank
        FROM (SELECT w, toks, turn, unnest(range(len(toks) - 1)) AS pos FROM state) p
        JOIN merges m ON m.pair = ((p.toks[p.pos + 1]::BIGINT << 20) | p.toks[p.pos + 2])
        GROUP BY p.w
    )
),
done AS (SELECT w, arg_max(toks, turn) AS toks FROM state GROUP BY w),
tokens AS (SELECT w, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM done)
SELECT w, string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS ids, string_agg(v.hex, '' ORDER BY pos) AS decoded
FROM tokens JOIN vocab v USING (tok) GROUP BY w
"""


def close(name: str) -> None:
    """At a task's end: the worker lives on, with the commonest words only."""
    coder(name).close()
    release_memory()


def read_ranks(name: str) -> dict[bytes, int]:
    from holdfast.llm.token_counts import _place

    with open(_place(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class WordCoder:
    """Encodes and decodes single matches; one per worker and rank file."""

    def __init__(self, name: str):
        self.ranks = ranks = read_ranks(name)
        merges = [((a << 20) | b, r) for tok, r in ranks.items() for i in range(1, len(tok)) if (a := ranks.get(tok[:i])) is not None and (b := ranks.get(tok[i:])) is not None]
        self.tables = {
            "merges": pa.table({"pair": pa.array([x for x, _ in merges], pa.int64()), "rank": pa.array([x for _, x in merges], pa.int32())}),
            "vocab": pa.table({"tok": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])}),
        }
        self.db = None
        self.tokens = {v: k for k, v in ranks.items()}
        self.single = [ranks[bytes([i])] for i in range(256)]
        #: word -> its ids, joined by spaces; and its decoded bytes where they are other than the word's
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def _open(self) -> None:
        import duckdb

        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '200MB'")
        for name, rows in self.tables.items():
            self.db.register("loaded", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
            self.db.unregister("loaded")

    def _by_heap(self, word: bytes) -> list[int]:
        """The same contraction for a very long match: a heap of pairs by (rank, place)."""
        rank = self.ranks.get
        parts = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(r, i) for i in range(len(word) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(word) or rank(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(word) and (n := rank(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (n, k))
        return [self.ranks[p] for p in parts if p is not None]

    def learn(self, new: set[str]) -> None:
        """Encodes the words and decodes what came out."""
        coded = [(w, w.encode()) for w in new]
        short = [(w, b) for w, b in coded if len(b) <= LONG_BYTES]
        for w, b in coded:
            if len(b) > LONG_BYTES:
                ids = self._by_heap(b)
                self._keep(w, b, " ".join(map(str, ids)), b"".join(self.tokens[i] for i in ids))
        for at in range(0, len(short), AT_ONCE):
            self._by_query(short[at : at + AT_ONCE])

    def _by_query(self, short: list[tuple[str, bytes]]) -> None:
        if self.db is None:
            self._open()
        toks = pa.array([[self.single[x] for x in b] for _, b in short], pa.list_(pa.int32()))
        self.db.register("start", pa.table({"w": pa.array(range(len(short)), pa.int32()), "toks": toks}))
        done = self.db.execute(ENCODE).fetchall()
        self.db.unregister("start")
        for i, ids, hexed in done:
            self._keep(*short[i], ids, bytes.fromhex(hexed))

    def _keep(self, word: str, coded: bytes, ids: str, decoded: bytes) -> None:
        self.ids[word] = ids.encode()
        if decoded != coded:
            self.odd[word] = decoded

    def trim(self) -> None:
        """Keeps the words that were learnt first: they are the commonest."""
        self.ids = dict(itertools.islice(self.ids.items(), KEEP_WORDS))
        self.odd = {w: b for w, b in self.odd.items() if w in self.ids}

    def close(self) -> None:
        self.trim()
        if self.db is not None:
            self.db.close()
            self.db = None


_CODERS: dict[str, WordCoder] = {}


def coder(name: str) -> WordCoder:
    if name not in _CODERS:
        _CODERS[name] = WordCoder(name)
    return _CODERS[name]


def _parts(texts: list[str | None], pattern) -> Iterator[list[tuple[int, list[str]]]]:
    """Blocks of (number of the text, its matches or some of them) with about SEGMENT matches each."""
    block, size = [], 0
    for i, t in enumerate(texts):
        if len(t or "") < SEGMENT:
            own = [pattern.findall(t or "")]
        else:
            found = pattern.finditer(t)
            own = iter(lambda found=found: [m[0] for m in itertools.islice(found, SEGMENT)], [])
        for p in own:
            block.append((i, p))
            size += len(p)
            if size >= SEGMENT:
                yield block
                block, size = [], 0
    yield block


def _digests(texts: list[str | None], name: str, pattern) -> Iterator[tuple[int, str, str]]:
    c = coder(name)
    state = [[0, hashlib.sha256(), hashlib.sha256()] for _ in texts]
    for block in _parts(texts, pattern):
        need = set().union(*[own for _, own in block])
        if len(c.ids) + len(need) > CACHE_WORDS:
            c.trim()
        if new := need.difference(c.ids):
            c.learn(new)
        for i, own in block:
            if own:
                s, ids = state[i], b" ".join(map(c.ids.__getitem__, own))
                s[1].update(b" " + ids if s[0] else ids)
                s[0] += ids.count(b" ") + 1
                s[2].update(b"".join([c.odd.get(p) or p.encode() for p in own]) if c.odd else "".join(own).encode())
    for n, a, b in state:
        yield n, a.hexdigest(), b.hexdigest()


def encode_documents(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row's text.

    `pattern` splits a text before the merges (None: public_tokenizers.PATTERN).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = pattern
        if cut is None:
            import public_tokenizers

            cut = public_tokenizers.PATTERN
        cut = regex.compile(cut)
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            got = list(_digests(b.column(1).to_pylist(), ranks, cut))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        close(ranks)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_ids(texts: list[str], ranks: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> list[list[int]]:
    """The ids themselves, for callers that need more than digests."""
    import public_tokenizers
    import regex

    c, cut = coder(ranks), regex.compile(pattern or public_tokenizers.PATTERN)
    out = []
    for t in texts:
        own = cut.findall(t or "")
        if new := set(own).difference(c.ids):
            c.learn(new)
        out.append([int(i) for p in own for i in c.ids[p].split()])
    return out
