"""Fixed byte layouts as struct columns, without Python: one expression for each field.

A layout is a list of (name, kind). Kinds: u8 u16 u24 u32 u64, i8 i16 i24 i32
i64 (a trailing > for big-endian), text:N (ASCII up to NUL), bytes:N, skip:N,
or another layout (a nested struct). Arrays are not fields of a layout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import bytesfn as bf


def size_of(kind) -> int:
    if isinstance(kind, list):
        return sum(size_of(k) for _, k in kind)
    if ":" in kind:
        return int(kind.split(":")[1])
    return int(kind.rstrip(">")[1:]) // 8


def read_struct(content: Column, offset: Column | int, layout: list) -> Column:
    """struct of the layout's fields at offset; a field past the end is null."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    out, moved = [], 0
    for name, kind in layout:
        here, n = at + moved, size_of(kind)
        if isinstance(kind, list):
            out.append(read_struct(content, here, kind).alias(name))
        elif kind.startswith("text:"):
            out.append(F.decode(F.unhex(F.regexp_extract(F.hex(bf.slice_of(content, here, n)), "^((?:..)*?)(?:00(?:..)*)?$", 1)), "US-ASCII").alias(name))
        elif kind.startswith("bytes:"):
            out.append(bf.slice_of(content, here, n).alias(name))
        elif not kind.startswith("skip:"):
            read = {"u": (bf.unsigned_le, bf.unsigned_be), "i": (bf.signed_le, bf.signed_be)}[kind[0]][kind.endswith(">")]
            out.append(read(content, here, n).alias(name))
        moved += n
    return F.struct(*out)


def records(content: Column, first: Column | int, count: Column, layout: list) -> Column:
    """array of `count` structs that follow each other."""
    first = first if isinstance(first, Column) else F.lit(first)
    n = size_of(layout)
    places = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: read_struct(content, first + i * n, layout))
