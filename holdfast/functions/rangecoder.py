"""An adaptive order-0 range coder, registered as the codec "range".

The stream begins with the number of bytes (four, little-endian). Counts start
at one, grow by INCREASE and are halved when their sum passes LIMIT.
"""

from __future__ import annotations

from holdfast.functions import codecs

INCREASE, LIMIT = 32, 1 << 16
TOP, BOTTOM = 1 << 24, 1 << 16
MASK = 0xFFFFFFFF


class _Model:
    """Counts of 256 symbols in a Fenwick tree."""

    def __init__(self):
        self.n = [1] * 256
        self._build()

    def _build(self):
        self.tree, self.sum = [0] * 257, sum(self.n)
        for i, v in enumerate(self.n):
            self._add(i, v)

    def _add(self, i, v):
        i += 1
        while i <= 256:
            self.tree[i] += v
            i += i & -i

    def low(self, s):
        out = 0
        while s:
            out += self.tree[s]
            s &= s - 1
        return out

    def find(self, at):
        s, step = 0, 256
        while step:
            if s + step <= 256 and self.tree[s + step] <= at:
                s += step
                at -= self.tree[s]
            step >>= 1
        return s

    def seen(self, s):
        self.n[s] += INCREASE
        self._add(s, INCREASE)
        self.sum += INCREASE
        if self.sum > LIMIT - INCREASE:
            self.n = [v + 1 >> 1 for v in self.n]
            self._build()


@codecs.encoder("range")
def encode(b: bytes) -> bytes:
    m, out, low, width = _Model(), bytearray(len(b).to_bytes(4, "little")), 0, MASK
    for s in b:
        width //= m.sum
        low = low + m.low(s) * width & MASK
        width *= m.n[s]
        m.seen(s)
        while (low ^ low + width) & MASK < TOP and low + width <= MASK or width < BOTTOM:
            if not ((low ^ low + width) & MASK < TOP and low + width <= MASK):
                width = -low & BOTTOM - 1 or BOTTOM
            out.append(low >> 24)
            low, width = low << 8 & MASK, width << 8 & MASK
    for _ in range(4):
        out.append(low >> 24)
        low = low << 8 & MASK
    return bytes(out)


@codecs.decoder("range")
def decode(b: bytes) -> bytes:
    n, at = int.from_bytes(b[:4], "little"), 8
    m, out, low, width, code = _Model(), bytearray(), 0, MASK, int.from_bytes(b[4:8].ljust(4, b"\0"), "big")
    while len(out) < n:
        if at > len(b) + 4:
            raise ValueError("truncated")
        width //= m.sum
        s = m.find(min((code - low & MASK) // width, m.sum - 1))
        low = low + m.low(s) * width & MASK
        width *= m.n[s]
        out.append(s)
        m.seen(s)
        while (low ^ low + width) & MASK < TOP and low + width <= MASK or width < BOTTOM:
            if not ((low ^ low + width) & MASK < TOP and low + width <= MASK):
                width = -low & BOTTOM - 1 or BOTTOM
            code = code << 8 & MASK | (b[at] if at < len(b) else 0)
            at += 1
            low, width = low << 8 & MASK, width << 8 & MASK
    return bytes(out)
