"""Charsets and text tests. Legacy code pages go through Arrow functions; the JVM refuses them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(b: Column, charset: str = "cp932", errors: str = "replace") -> Column:
    """Text of whole fields."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else v.decode(charset, errors) for v in x.to_pylist()], pa.string())

    return run(b)


def c_string(b: Column, charset: str = "cp932") -> Column:
    """Text up to the first NUL or the end of the field."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else v.split(b"\0", 1)[0].decode(charset, "replace") for v in x.to_pylist()], pa.string())

    return run(b)


def encode_strict(s: Column, charset: str = "cp932") -> Column:
    """Bytes of a name, null where the charset cannot hold it."""

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        def one(v):
            try:
                return None if v is None else v.encode(charset)
            except UnicodeEncodeError:
                return None

        return pa.array([one(v) for v in x.to_pylist()], pa.binary())

    return run(s)


def lower_ascii(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_sjis(b: Column) -> Column:
    """ASCII letters of a double-byte string in lower case; second bytes stay."""

    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        def one(v):
            out, i = bytearray(v), 0
            while i < len(out):
                c = out[i]
                if 0x81 <= c <= 0x9F or 0xE0 <= c <= 0xFC:
                    i += 2
                    continue
                if 0x41 <= c <= 0x5A:
                    out[i] = c + 32
                i += 1
            return bytes(out)

        return pa.array([None if v is None else one(v) for v in x.to_pylist()], pa.binary())

    return run(b)


def guess_encoding(b: Column, default: str = "default") -> Column:
    """By byte order mark."""
    h = F.hex(F.substring(b, 1, 3))
    return F.when(h == "EFBBBF", "utf-8").when(h.startswith("FFFE"), "utf-16le").when(h.startswith("FEFF"), "utf-16be").otherwise(default)


def is_text(head: Column, size: Column) -> Column:
    """head: the first 0x400 bytes. A byte order mark makes it text, control bytes binary; else it needs a line feed or under 80 bytes."""
    h = F.hex(head)
    marked = guess_encoding(head) != "default"
    control = h.rlike("^(?:..)*?(?:0[0-8EF]|1[0-9ACDEF])")
    return marked | (~control & (h.rlike("^(?:..)*?0A") | (size < 80)))
