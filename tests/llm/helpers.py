"""Fixtures that every operator meets: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, n_words string, rules string, row string, w string"


def docs_frame(spark, texts, sources=None, start=0):
    rows = [(start + i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "x", None, "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, vocab=400):
    r = random.Random(seed)
    syl = ["ba", "ko", "ri", "ten", "mor", "la", "shi", "ver", "on", "du", "é", "ñu"]
    pool = random.Random(7)
    words = ["".join(pool.choice(syl) for _ in range(pool.randint(1, 4))) for _ in range(vocab)]
    out = []
    for i in range(n):
        w = r.choice(words)
        out.append(w.capitalize() + "." if i % 17 == 16 else w)
    return " ".join(out)


ODD = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "a",
    "one two three four five",
    "x\x1cy\x85z w   q",
    "it's we'll I'd 12345 ... !!! \U0001f600\U0001f600 é",
    "a" * 3000,
    "word " * 9000,
    "same line\nsame line\nsame line\n\nother",
    "<|endoftext|> literal <|endoftext|>",
    "tab\tand\nnewline  double  space ",
    prose(1, 700),
    prose(1, 700),
    prose(2, 60),
]
