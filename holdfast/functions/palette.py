"""Palettes: six orders of bytes to ARGB numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions.bytesfn import slice_of, unsigned_le

#: format -> (bytes a colour, places of red, green, blue, alpha; None: opaque)
ORDERS = {
    "rgb": (3, 0, 1, 2, None),
    "bgr": (3, 2, 1, 0, None),
    "rgbx": (4, 0, 1, 2, None),
    "bgrx": (4, 2, 1, 0, None),
    "rgba": (4, 0, 1, 2, 3),
    "bgra": (4, 2, 1, 0, 3),
}


def read_palette(content: Column, offset, colours: int = 256, order: str = "bgrx") -> Column:
    """array<int> of ARGB colours; null if the bytes do not reach."""
    size, r, g, b, a = ORDERS[order]
    part = slice_of(content, offset, colours * size)
    byte = lambda i, k: unsigned_le(part, i * size + k, 1)
    alpha = (lambda i: byte(i, a)) if a is not None else (lambda i: F.lit(255).cast("bigint"))
    argb = lambda i: F.shiftleft(alpha(i), 24) + F.shiftleft(byte(i, r), 16) + F.shiftleft(byte(i, g), 8) + byte(i, b)
    signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")
    return F.when(part.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(colours - 1)), lambda i: signed(argb(i))))
