"""Scripts as lines, and nested key/value text as JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import text

LINES = "array<struct<id: bigint, text: string>>"


def is_script(content: Column) -> Column:
    """Text by its first 0x400 bytes, not over the display limit of 0xFFFFFF bytes."""
    return text.is_text(F.substring(content, 1, 0x400), F.octet_length(content)) & (F.octet_length(content) <= 0xFFFFFF)


def read_lines(content: Column, charset: str = "cp932") -> Column:
    """Ordered (id, text) of the lines that are not empty; id is the line's number."""
    lines = F.split(text.decode(content, charset), "\r?\n")
    numbered = F.transform(lines, lambda t, i: F.struct(i.cast("bigint").alias("id"), t.alias("text")))
    return F.filter(numbered, lambda x: F.length(x.text) > 0)


def write_lines(lines: Column, charset: str = "cp932") -> Column:
    """The lines at the numbers that their ids say, empty ones between; null where the charset cannot hold them."""

    @F.udf("binary", useArrow=True)
    def run(rows):
        if rows is None:
            return None
        at = {r["id"]: r["text"] or "" for r in rows}
        try:
            return "\n".join(at.get(i, "") for i in range(max(at, default=-1) + 1)).encode(charset)
        except UnicodeEncodeError:
            return None

    return run(lines)


_TOKEN = re.compile(r'\s*(?:(?P<s>"(?:[^"\\]|\\.)*")|(?P<n>-?\d+(?:\.\d+)?)|(?P<w>[A-Za-z_]\w*)|(?P<p>[{}=,;]))')


def parse_table(source: str):
    """Nested tables `{ key = value, value, { ... } }` of strings, numbers, true, false and nil.

    A table with keys is a dict (values without one under "1", "2", ...), one
    without a list.
    """
    tokens, at = [], 0
    source = re.sub(r"--[^\n]*", "", source)
    while at < len(source.rstrip()):
        m = _TOKEN.match(source, at)
        if not m:
            raise ValueError(f"unexpected text at {at}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    i = 0

    def value():
        nonlocal i
        if i >= len(tokens):
            raise ValueError("unexpected end")
        kind, t = tokens[i]
        i += 1
        if kind == "s":
            return json.loads(t)
        if kind == "n":
            return float(t) if "." in t else int(t)
        if kind == "w":
            return {"true": True, "false": False, "nil": None}.get(t, t)
        if t != "{":
            raise ValueError(f"unexpected {t}")
        return body("}")

    def body(end):
        nonlocal i
        named, plain = {}, []
        while i < len(tokens) and tokens[i][1] != end:
            if tokens[i][1] in ",;" and tokens[i][0] == "p":
                i += 1
            elif tokens[i][0] == "w" and i + 1 < len(tokens) and tokens[i + 1] == ("p", "="):
                key = tokens[i][1]
                i += 2
                named[key] = value()
            else:
                plain.append(value())
        if end is not None:
            if i >= len(tokens):
                raise ValueError("a table without an end")
            i += 1
        if not named:
            return plain
        return named | {str(k + 1): v for k, v in enumerate(plain)}

    return body(None)


def table_as_json(source: Column) -> Column:
    """JSON text of nested tables (parse_json makes it a VARIANT); null where the text is malformed."""

    @F.udf("string", useArrow=True)
    def run(s):
        try:
            return None if s is None else json.dumps(parse_table(s), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return run(source)
