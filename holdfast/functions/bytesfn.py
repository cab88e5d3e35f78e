"""Byte readers and bit operations as Column expressions (no Python on the executors).

Unsigned 32-bit values are BIGINT, unsigned 64-bit ones DECIMAL(20,0). A read
past the end gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reversed_hex(b: Column) -> Column:
    """Hex digits of the bytes from the last to the first (reverse() itself works on characters)."""
    return F.regexp_replace(F.reverse(F.hex(b)), "(.)(.)", "$2$1")


def slice_of(b: Column, offset, size) -> Column:
    """size bytes at offset, null if there are fewer."""
    offset, size = (x if isinstance(x, Column) else F.lit(x) for x in (offset, size))
    return F.when((offset >= 0) & (size >= 0) & (F.octet_length(b) >= offset + size), F.substring(b, (offset + 1).cast("int"), size.cast("int")))


def member(b: Column, offset, size) -> Column:
    """A member's bytes: empty for size 0, cut at the end of the file, null where its place is beyond it."""
    offset, size = (x if isinstance(x, Column) else F.lit(x) for x in (offset, size))
    inside = (offset >= 0) & (offset < F.octet_length(b)) & (size > 0)
    return F.when(size == 0, F.lit(b"")).when(inside, F.substring(b, (offset + 1).cast("int"), F.least(size, F.octet_length(b)).cast("int")))


def unsigned_be(b: Column, offset, n: int) -> Column:
    return F.conv(F.hex(slice_of(b, offset, n)), 16, 10).cast("bigint" if n < 8 else "decimal(20,0)")


def unsigned_le(b: Column, offset, n: int) -> Column:
    return F.conv(reversed_hex(slice_of(b, offset, n)), 16, 10).cast("bigint" if n < 8 else "decimal(20,0)")


def _signed(x: Column, n: int) -> Column:
    half, full = 1 << (8 * n - 1), 1 << (8 * n)
    if n < 8:
        return F.when(x >= half, x - F.lit(full)).otherwise(x)
    big = lambda v: F.lit(str(v)).cast("decimal(20,0)")
    return F.when(x >= big(half), (x - big(full))).otherwise(x).cast("bigint")


def signed_le(b: Column, offset, n: int) -> Column:
    return _signed(unsigned_le(b, offset, n), n)


def signed_be(b: Column, offset, n: int) -> Column:
    return _signed(unsigned_be(b, offset, n), n)


def pack_be(x: Column, n: int) -> Column:
    return F.unhex(F.substring(F.lpad(F.hex(x.cast("bigint")), 16, "0"), -2 * n, 2 * n))


def pack_le(x: Column, n: int) -> Column:
    return F.unhex(reversed_hex(pack_be(x, n)))


def byte_swap(x: Column, n: int) -> Column:
    return F.conv(F.hex(pack_le(x, n)), 16, 10).cast("bigint" if n < 8 else "decimal(20,0)")


def bytes_equal(b: Column, offset, what: bytes) -> Column:
    return F.coalesce(slice_of(b, offset, len(what)) == F.lit(what), F.lit(False))


def ascii_equal(b: Column, offset, what: str) -> Column:
    return bytes_equal(b, offset, what.encode("ascii"))


def rotate_left(x: Column, n: int, width: int) -> Column:
    """Rotation of an unsigned number of 8, 16 or 32 bits."""
    mask = (1 << width) - 1
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x.bitwiseAND(mask), width - n)).bitwiseAND(F.lit(mask))


def rotate_right(x: Column, n: int, width: int) -> Column:
    return rotate_left(x, width - n, width)


def rotate_left_64(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def bytes_per_second(rate: Column, channels: Column, bits: Column) -> Column:
    return F.floor(rate * channels * bits / 8).cast("bigint")


def stride(width: Column, bpp: Column) -> Column:
    return (width * F.floor((bpp + 7) / 8)).cast("bigint")


def find_bytes(b: Column, what: bytes, start=0) -> Column:
    """Offset of the first occurrence at or after start, -1 if none: hex search on an even place."""
    h = F.hex(F.substring(b, (F.lit(start) + 1).cast("int"), F.octet_length(b)))
    hit = F.regexp_instr(h, F.lit(f"^(?:..)*?({what.hex().upper()})"), F.lit(1))
    at = F.length(F.regexp_extract(h, f"^((?:..)*?){what.hex().upper()}", 1)) / 2
    return F.when(hit > 0, at.cast("bigint") + start).otherwise(F.lit(-1).cast("bigint"))
