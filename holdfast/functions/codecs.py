"""Byte transforms: a registry of decoders, encoders and checksums behind Arrow functions.

Each handles whole buffers. Bad input gives null, never a failed job;
decode_checked returns the message beside it, and whatever opens members uses
that one. Keys are arguments; none is stored here.
"""

from __future__ import annotations

import binascii
import bz2
import functools
import itertools
import lzma
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DECODERS: dict[str, Callable] = {}
ENCODERS: dict[str, Callable] = {}
CHECKSUMS: dict[str, Callable[[bytes], int]] = {}


def decoder(name):
    return lambda f: DECODERS.setdefault(name, f)


def encoder(name):
    return lambda f: ENCODERS.setdefault(name, f)


def _wrap(f, options):
    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        def one(v):
            if v is None:
                return None
            try:
                return bytes(f(v, **options))
            except Exception:  # noqa: BLE001  a member that is not in this form
                return None

        return pa.array([one(v) for v in x.to_pylist()], pa.binary())

    return run


def decode(name: str, **options) -> Callable[[Column], Column]:
    return _wrap(DECODERS[name], options)


def encode(name: str, **options) -> Callable[[Column], Column]:
    return _wrap(ENCODERS[name], options)


def decode_checked(name: str, **options) -> Callable[[Column], Column]:
    """struct(data, error): the reason stands beside a null."""
    f = DECODERS[name]

    @F.arrow_udf("struct<data: binary, error: string>")
    def run(x: pa.Array) -> pa.Array:
        data, errors = [], []
        for v in x:
            got, why = None, None
            if v.is_valid:
                try:
                    got = bytes(f(v.as_py(), **options))
                except Exception as e:  # noqa: BLE001  reported with its row
                    why = f"{type(e).__name__}: {e}"
            data.append(got)
            errors.append(why)
        return pa.StructArray.from_arrays([pa.array(data, pa.binary()), pa.array(errors, pa.string())], ["data", "error"])

    return run


def checksum(name: str) -> Callable[[Column], Column]:
    f = CHECKSUMS[name]

    @F.arrow_udf("bigint" if name != "crc64" else "string")
    def run(x: pa.Array) -> pa.Array:
        values = x.to_pylist()
        if name == "crc64":
            some = iter(crc64_of([v for v in values if v is not None]))
            return pa.array([None if v is None else f"{next(some):016x}" for v in values], pa.string())
        return pa.array([None if v is None else f(v) for v in values], pa.int64())

    return run


# checksums: tables follow from the polynomials


@functools.cache
def _reflected(poly: int) -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ poly if c & 1 else c >> 1
        out.append(c)
    return out


#: each byte with its bits in reverse
_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def crc32_normal(b: bytes) -> int:
    """Highest bit first: the mirror image of zlib's over mirrored bytes."""
    return int(f"{zlib.crc32(b.translate(_MIRROR)):032b}"[::-1], 2)


def crc16(b: bytes) -> int:
    return binascii.crc_hqx(b, 0)


def crc64_of(values: list[bytes]) -> list[int]:
    """One step a byte place for all values that are so long; the rest of the few longest one by one."""
    t = _reflected(0xC96C5795D7870F42)
    table, order = np.array(t, np.uint64), sorted(range(len(values)), key=lambda i: -len(values[i]))
    flat = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    sizes = np.array([len(values[i]) for i in order], np.int64)
    starts, c, out = np.cumsum(sizes) - sizes, np.full(len(order), 0xFFFFFFFFFFFFFFFF, np.uint64), [0] * len(values)
    active, at = len(order), 0
    while active >= 16:
        if not (active := int(np.searchsorted(-sizes, -at, side="left"))) >= 16:
            break
        low = (c[:active] ^ flat[starts[:active] + at]) & np.uint64(0xFF)
        c[:active] = c[:active] >> np.uint64(8) ^ table[low.astype(np.int64)]
        at += 1
    for k, i in enumerate(order):
        v = int(c[k])
        for x in values[i][at:] if len(values[i]) > at else b"":
            v = v >> 8 ^ t[(v ^ x) & 0xFF]
        out[i] = v ^ 0xFFFFFFFFFFFFFFFF
    return out


def crc64(b: bytes) -> int:
    return crc64_of([b])[0]


CHECKSUMS |= {"adler32": zlib.adler32, "crc32": zlib.crc32, "crc32_normal": crc32_normal, "crc16": crc16, "crc64": crc64}

# general compression

DECODERS["zlib"], ENCODERS["zlib"] = lambda b: zlib.decompress(b), lambda b, level=6: zlib.compress(b, level)
DECODERS["deflate"], ENCODERS["deflate"] = lambda b: zlib.decompress(b, -15), lambda b, level=6: zlib.compress(b, level, -15)
DECODERS["gzip"], ENCODERS["gzip"] = lambda b: zlib.decompress(b, 31), lambda b, level=6: zlib.compress(b, level, 31)
DECODERS["bz2"], ENCODERS["bz2"] = bz2.decompress, bz2.compress


@decoder("zstd")
def _unzstd(b):
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(b)


@encoder("zstd")
def _zstd(b, level=3):
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(b)


@decoder("lzma")
def _unlzma(b, size=None):
    """Raw LZMA1: one byte of properties, four of dictionary size, then the stream."""
    p, d = b[0], int.from_bytes(b[1:5], "little")
    f = [{"id": lzma.FILTER_LZMA1, "dict_size": max(d, 4096), "lc": p % 9, "lp": p // 9 % 5, "pb": p // 45}]
    out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=f).decompress(b[5:], max_length=-1 if size is None else size)
    return out


@decoder("zip_lzma")
def _unzip_lzma(b):
    """As ZIP files hold it: two bytes of version and two of the properties' size go first."""
    if int.from_bytes(b[2:4], "little") != 5:
        raise ValueError("properties of another size")
    return _unlzma(b[4:])


@encoder("lzma")
def _lzma(b):
    f = [{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}]
    return bytes([(2 * 5 + 0) * 9 + 3]) + (1 << 20).to_bytes(4, "little") + lzma.compress(b, lzma.FORMAT_RAW, filters=f)


@decoder("layla")
def _unlayla(b):
    """A head, the body packed from its end backwards, then the first bytes as they are.

    Bits from the last byte on: 0 and a literal, or 1, a distance of 13 bits
    less 3, and a length of 3 and fields of 2, 3, 5 and then 8 bits, each
    followed by another while it is all ones.
    """
    if b[:8] != b"CRILAYLA":
        raise ValueError("not this form")
    size, packed = struct.unpack_from("<II", b, 8)
    body, out, bit = b[16 : 16 + packed][::-1], bytearray(), 0
    total = 8 * len(body)

    def take(k: int) -> int:
        nonlocal bit
        if bit + k > total:
            raise ValueError("ends early")
        first, last = bit >> 3, (bit + k + 7) >> 3
        v = int.from_bytes(body[first:last], "big") >> ((last << 3) - bit - k) & ((1 << k) - 1)
        bit += k
        return v

    while len(out) < size:
        if not take(1):
            out.append(take(8))
            continue
        back, count = take(13) + 3, 3
        for k in itertools.chain((2, 3, 5), itertools.repeat(8)):
            more = take(k)
            count += more
            if more != (1 << k) - 1:
                break
        if back > len(out):
            raise ValueError("bad distance")
        piece = out[len(out) - back : len(out) - back + count]
        while len(piece) < count:
            piece += piece[: count - len(piece)]
        out += piece
    return b[16 + packed :] + bytes(out[:size][::-1])


#: fixed value of the format
_AFF_KEY = bytes((0xC8, 0xBB, 0x8F, 0xB7, 0xED, 0x43, 0x99, 0x4A, 0xA2, 0x7E, 0x5B, 0xB0, 0x68, 0x18, 0xF8, 0x88))


@decoder("aff")
def _unaff(b):
    """A head of 16 bytes, then data whose first 64 bytes are combined with a key."""
    if b[:4] != b"AFF\0":
        raise ValueError("not this form")
    return bytes(x ^ y for x, y in zip(b[16:80], itertools.cycle(_AFF_KEY))) + b[80:]


@decoder("nbz")
def _unnbz(b):
    """Four bytes of size, highest first, then bzip2."""
    out = bz2.decompress(b[4:])
    if len(out) != int.from_bytes(b[:4], "big"):
        raise ValueError("another size than stated")
    return out


@decoder("spb")
def _unspb(b):
    """A picture as three planes of steps: width, height, then groups of four values after a 3-bit width; gives a BMP.

    Rows run to and fro, and planes are blue, green and red.
    """
    w, h = int.from_bytes(b[:2], "big"), int.from_bytes(b[2:4], "big")
    chunk, left, at = b[4:], 8 * (len(b) - 4), 0

    def take(k: int) -> int:
        nonlocal at
        if at + k > left:
            raise ValueError("ends early")
        first, last = at >> 3, (at + k + 7) >> 3
        v = int.from_bytes(chunk[first:last], "big") >> ((last << 3) - at - k) & ((1 << k) - 1)
        at += k
        return v

    stride = (3 * w + 3) & ~3
    pixels = np.zeros((h, stride), np.uint8)
    for plane in range(3):
        c = take(8)
        v = bytearray([c])
        while len(v) < w * h:
            n = take(3)
            if n == 0:
                v += bytes([c]) * 4
                continue
            m = take(1) + 1 if n == 7 else n + 2
            for _ in range(4):
                if m == 8:
                    c = take(8)
                else:
                    k = take(m)
                    c = c + (k >> 1) + 1 & 0xFF if k & 1 else c - (k >> 1) & 0xFF
                v.append(c)
        rows = np.frombuffer(bytes(v[: w * h]), np.uint8).reshape(h, w).copy()
        rows[1::2] = rows[1::2, ::-1]
        pixels[:, plane : 3 * w : 3] = rows[::-1]
    size = 54 + pixels.size
    return b"BM" + size.to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, pixels.size, 0, 0, 0, 0) + pixels.tobytes()


# sliding window

#: fixed values of the format
LZSS_FRAME, LZSS_START, LZSS_MIN, LZSS_MAX = 0x1000, 0xFEE, 3, 18


@decoder("lzss")
def lzss_decode(b, size=None, frame=LZSS_FRAME, start=LZSS_START, fill=0):
    """Control bits, lowest first: 1 a literal, 0 a pair (offset low; offset high in the top four bits, length - 3)."""
    # the frame is what was written last, so a pair is a slice of the output behind a frame of fill
    out, i, n, ahead = bytearray([fill]) * frame, 0, len(b), frame - start
    while i < n and (size is None or len(out) < size + frame):
        flags = b[i] | 0x100
        i += 1
        if flags == 0x1FF and i + 8 <= n:
            out += b[i : i + 8]
            i += 8
            continue
        while flags > 1 and i < n:
            if flags & 1:
                out.append(b[i])
                i += 1
            else:
                if i + 1 >= n:
                    i = n
                    break
                src, count = b[i] | (b[i + 1] & 0xF0) << 4, (b[i + 1] & 0xF) + LZSS_MIN
                i += 2
                end = len(out)
                back = (end - ahead - src - 1) % frame + 1
                piece = out[end - back : end - back + count]
                while len(piece) < count:
                    piece += piece[: count - len(piece)]
                out += piece
            flags >>= 1
    return out[frame:] if size is None else out[frame : frame + size]


@encoder("lzss")
def lzss_encode(b, frame=LZSS_FRAME, start=LZSS_START):
    """Greedy: the latest place of each three bytes is tried."""
    out, last, i, n = bytearray(), {}, 0, len(b)
    while i < n:
        flags, unit = 0, bytearray()
        for bit in range(8):
            if i >= n:
                break
            k, j = b[i : i + 3], -1
            if len(k) == 3:
                j = last.get(k, -1)
                last[k] = i
            if j >= 0 and i - j < frame - LZSS_MAX:
                m, most = 3, min(LZSS_MAX, n - i)
                while m < most and b[j + m] == b[i + m]:
                    m += 1
                p = (start + j) % frame
                unit += bytes((p & 0xFF, p >> 4 & 0xF0 | m - LZSS_MIN))
                for x in range(i + 1, min(i + m, n - 2)):
                    last[b[x : x + 3]] = x
                i += m
            else:
                flags |= 1 << bit
                unit.append(b[i])
                i += 1
        out.append(flags)
        out += unit
    return out


@decoder("lz4_block")
def lz4_block(b, history=b""):
    out, i, n = bytearray(history), 0, len(b)
    while i < n:
        token = b[i]
        i += 1
        lit = token >> 4
        if lit == 15:
            while True:
                lit += b[i]
                i += 1
                if b[i - 1] != 255:
                    break
        out += b[i : i + lit]
        i += lit
        if i >= n:
            break
        back = b[i] | b[i + 1] << 8
        i += 2
        count = (token & 15) + 4
        if token & 15 == 15:
            while True:
                count += b[i]
                i += 1
                if b[i - 1] != 255:
                    break
        if not 0 < back <= len(out):
            raise ValueError("bad distance")
        p = len(out) - back
        for k in range(count):
            out.append(out[p + k])
    return out[len(history) :]


@encoder("lz4_block")
def lz4_block_encode(b):
    """Literals only: valid, not small."""
    n = len(b)
    head = bytes([min(n, 15) << 4])
    if n >= 15:
        head += b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])
    return head + b


@decoder("lz4")
def lz4_frame(b):
    if b[:4] != b"\x04\x22\x4d\x18":
        raise ValueError("not a frame")
    flags, i = b[4], 7
    i += 8 * bool(flags & 8) + 4 * bool(flags & 1)
    out = bytearray()
    while (size := int.from_bytes(b[i : i + 4], "little")) and i < len(b):
        i += 4
        part = b[i : i + (size & 0x7FFFFFFF)]
        i += (size & 0x7FFFFFFF) + 4 * bool(flags & 16)
        out += part if size >> 31 else lz4_block(part, b"" if flags & 32 else bytes(out[-65536:]))
    return out


# Huffman: bits from the highest; tree: 1 a node, 0 a leaf of eight bits


@decoder("huffman")
def huffman_decode(b, size=None):
    """The tree stands first; `size` symbols follow (all that are whole, if None)."""
    bits, at = int.from_bytes(b, "big"), 0
    n = 8 * len(b)
    text = bin(bits)[2:].zfill(n)

    def tree():
        nonlocal at
        at += 1
        if text[at - 1] == "1":
            return tree(), tree()
        at += 8
        return int(text[at - 8 : at], 2)

    root, out = tree(), bytearray()
    while (size is None or len(out) < size) and at < n or (size is not None and len(out) < size and isinstance(root, int)):
        node = root
        while not isinstance(node, int):
            if at >= n:
                return out
            node = node[text[at] == "1"]
            at += 1
        out.append(node)
        if isinstance(root, int) and size is None:
            break
    return out


@encoder("huffman")
def huffman_encode(b):
    import heapq
    from collections import Counter

    heap = [(n, i, s) for i, (s, n) in enumerate(sorted(Counter(b).items()))]
    heapq.heapify(heap)
    k = 256
    while len(heap) > 1:
        x, y = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (x[0] + y[0], k, (x[2], y[2])))
        k += 1
    codes, out = {}, []

    def walk(node, code):
        if isinstance(node, tuple):
            out.append("1")
            walk(node[0], code + "0")
            walk(node[1], code + "1")
        else:
            out.append("0" + f"{node:08b}")
            codes[node] = code

    if not heap:
        return b""
    walk(heap[0][2], "")
    bits = "".join(out) + "".join(codes[x] for x in b)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


# runs, move to front, block sorting


@decoder("rle")
def rle_decode(b):
    """A count below 128: so many + 1 literals; above: 257 - count times the next byte."""
    out, i = bytearray(), 0
    while i < len(b):
        c = b[i]
        if c < 128:
            out += b[i + 1 : i + 2 + c]
            i += 2 + c
        else:
            out += b[i + 1 : i + 2] * (257 - c)
            i += 2
    return out


@encoder("rle")
def rle_encode(b):
    out, i = bytearray(), 0
    while i < len(b):
        n = 1
        while n < 128 and i + n < len(b) and b[i + n] == b[i]:
            n += 1
        if n > 2:
            out += bytes((257 - n, b[i]))
            i += n
            continue
        j = i
        while j < len(b) and j - i < 128 and b[j : j + 3] != b[j : j + 1] * 3:
            j += 1
        out += bytes([j - i - 1]) + b[i:j]
        i = j
    return out


@decoder("mtf")
def mtf_decode(b):
    order, out = list(range(256)), bytearray()
    for x in b:
        c = order.pop(x)
        order.insert(0, c)
        out.append(c)
    return out


@encoder("mtf")
def mtf_encode(b):
    order, out = list(range(256)), bytearray()
    for c in b:
        x = order.index(c)
        out.append(x)
        order.pop(x)
        order.insert(0, c)
    return out


@decoder("bwt")
def bwt_decode(b):
    """Four bytes (little-endian) name the row of the text; the last column follows."""
    row, last = int.from_bytes(b[:4], "little"), b[4:]
    order = sorted(range(len(last)), key=lambda i: (last[i], i))
    out = bytearray()
    for _ in last:
        row = order[row]
        out.append(last[row])
    return out


@encoder("bwt")
def bwt_encode(b):
    rows = sorted(range(len(b)), key=lambda i: b[i:] + b[:i])
    return (rows.index(0) if b else 0).to_bytes(4, "little") + bytes(b[i - 1] for i in rows)


# ciphers with the caller's key


def _xor(b, key, at=0):
    k = int.from_bytes((key * (len(b) // len(key) + 2))[at % len(key) : at % len(key) + len(b)], "big")
    return (int.from_bytes(b, "big") ^ k).to_bytes(len(b), "big")


DECODERS["xor"] = ENCODERS["xor"] = _xor
DECODERS["not"] = ENCODERS["not"] = lambda b: _xor(b, b"\xff")
DECODERS["add"], ENCODERS["add"] = lambda b, n=1: bytes(x - n & 255 for x in b), lambda b, n=1: bytes(x + n & 255 for x in b)
DECODERS["rotate"], ENCODERS["rotate"] = lambda b, n=4: bytes((x >> n | x << 8 - n) & 255 for x in b), lambda b, n=4: bytes((x << n | x >> 8 - n) & 255 for x in b)


def _rc4(b, key):
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for x in b:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(x ^ s[(s[i] + s[j]) & 255])
    return out


DECODERS["rc4"] = ENCODERS["rc4"] = _rc4


@functools.cache
def _pi_words(n: int) -> list[int]:
    """The first n 32-bit words of the fraction of pi."""
    bits = 32 * n + 64

    def arctan_inverse(x):
        total = term = (1 << bits) // x
        k, sign = 3, -1
        while term:
            term //= x * x
            total += sign * (term // k)
            k, sign = k + 2, -sign
        return total

    frac = (16 * arctan_inverse(5) - 4 * arctan_inverse(239)) & (1 << bits) - 1
    return [frac >> bits - 32 * (i + 1) & 0xFFFFFFFF for i in range(n)]


@functools.lru_cache(maxsize=64)
def _blowfish(key: bytes):
    w = _pi_words(18 + 1024)
    p, s = w[:18], w[18:]
    cyc = key * (72 // len(key) + 1)
    p = [x ^ int.from_bytes(cyc[4 * i : 4 * i + 4], "big") for i, x in enumerate(p)]

    def f(x):
        return ((s[x >> 24] + s[256 + (x >> 16 & 255)] & 0xFFFFFFFF) ^ s[512 + (x >> 8 & 255)]) + s[768 + (x & 255)] & 0xFFFFFFFF

    def crypt(a, b, keys):
        for i in range(0, 16):
            a ^= keys[i]
            b ^= f(a)
            a, b = b, a
        a, b = b, a
        return a ^ keys[17], b ^ keys[16]

    a = b = 0
    for t in (p, s):
        for i in range(0, len(t), 2):
            a, b = crypt(a, b, p)
            t[i], t[i + 1] = a, b
    return p, crypt


def _blocks(b, key, flip, order):
    p, crypt = _blowfish(key)
    keys, out = (p[::-1] if flip else p), bytearray()
    for i in range(0, len(b) - 7, 8):
        x, y = crypt(int.from_bytes(b[i : i + 4], order), int.from_bytes(b[i + 4 : i + 8], order), keys)
        out += x.to_bytes(4, order) + y.to_bytes(4, order)
    return bytes(out) + b[len(out) :]


DECODERS["blowfish"] = lambda b, key, order="big": _blocks(b, key, True, order)
ENCODERS["blowfish"] = lambda b, key, order="big": _blocks(b, key, False, order)


def _rol(x, n):
    n &= 31
    return (x << n | x >> 32 - n) & 0xFFFFFFFF if n else x


@functools.lru_cache(maxsize=64)
def _rc6_keys(key: bytes, rounds: int) -> list[int]:
    c = max(1, -(-len(key) // 4))
    words = [int.from_bytes(key[4 * i : 4 * i + 4].ljust(4, b"\0"), "little") for i in range(c)]
    s = [(0xB7E15163 + 0x9E3779B9 * i) & 0xFFFFFFFF for i in range(2 * rounds + 4)]
    a = b = i = j = 0
    for _ in range(3 * max(c, len(s))):
        a = s[i] = _rol((s[i] + a + b) & 0xFFFFFFFF, 3)
        b = words[j] = _rol((words[j] + a + b) & 0xFFFFFFFF, a + b)
        i, j = (i + 1) % len(s), (j + 1) % c
    return s


def _rc6(b, key, rounds, back):
    s, out, m = _rc6_keys(key, rounds), bytearray(), 0xFFFFFFFF
    for at in range(0, len(b) - 15, 16):
        w, x, y, z = (int.from_bytes(b[at + 4 * k : at + 4 * k + 4], "little") for k in range(4))
        if not back:
            x, z = x + s[0] & m, z + s[1] & m
            for i in range(1, rounds + 1):
                t, u = _rol(x * (2 * x + 1) & m, 5), _rol(z * (2 * z + 1) & m, 5)
                w, y = _rol(w ^ t, u) + s[2 * i] & m, _rol(y ^ u, t) + s[2 * i + 1] & m
                w, x, y, z = x, y, z, w
            w, y = w + s[2 * rounds + 2] & m, y + s[2 * rounds + 3] & m
        else:
            y, w = y - s[2 * rounds + 3] & m, w - s[2 * rounds + 2] & m
            for i in range(rounds, 0, -1):
                w, x, y, z = z, w, x, y
                u, t = _rol(z * (2 * z + 1) & m, 5), _rol(x * (2 * x + 1) & m, 5)
                y, w = _rol(y - s[2 * i + 1] & m, 32 - (t & 31)) ^ u, _rol(w - s[2 * i] & m, 32 - (u & 31)) ^ t
            z, x = z - s[1] & m, x - s[0] & m
        out += b"".join(v.to_bytes(4, "little") for v in (w, x, y, z))
    return bytes(out) + b[len(out) :]


DECODERS["rc6"] = lambda b, key, rounds=20: _rc6(b, key, rounds, True)
ENCODERS["rc6"] = lambda b, key, rounds=20: _rc6(b, key, rounds, False)


def aes_cbc_decrypt(b: Column, key: Column, iv: Column) -> Column:
    """Spark's own AES: the IV stands before the data."""
    return F.aes_decrypt(F.concat(iv, b), key, F.lit("CBC"), F.lit("PKCS"))


# keystreams


class Mersenne:
    """MT19937 words from a seed."""

    def __init__(self, seed: int):
        self.s, self.i = [seed & 0xFFFFFFFF], 624
        for i in range(1, 624):
            self.s.append((1812433253 * (self.s[-1] ^ self.s[-1] >> 30) + i) & 0xFFFFFFFF)

    def next(self) -> int:
        if self.i == 624:
            for k in range(624):
                y = self.s[k] & 0x80000000 | self.s[(k + 1) % 624] & 0x7FFFFFFF
                self.s[k] = self.s[(k + 397) % 624] ^ y >> 1 ^ (0x9908B0DF if y & 1 else 0)
            self.i = 0
        y = self.s[self.i]
        self.i += 1
        y ^= y >> 11
        y ^= y << 7 & 0x9D2C5680
        y ^= y << 15 & 0xEFC60000
        return y ^ y >> 18


def _mersenne(b, seed):
    g = Mersenne(seed)
    return _xor(b, b"".join(g.next().to_bytes(4, "little") for _ in range(len(b) // 4 + 1))) if b else b


DECODERS["mersenne_xor"] = ENCODERS["mersenne_xor"] = _mersenne


class Bits:
    """Bit reader: highest or lowest bit first."""

    def __init__(self, b: bytes, msb: bool = True):
        self.b, self.msb, self.at = b, msb, 0

    def get(self, n: int) -> int | None:
        """n bits, None past the end."""
        if self.at + n > 8 * len(self.b):
            return None
        out = 0
        for k in range(n):
            byte, bit = divmod(self.at + k, 8)
            v = self.b[byte] >> (7 - bit if self.msb else bit) & 1
            out = out << 1 | v if self.msb else out | v << k
        self.at += n
        return out
