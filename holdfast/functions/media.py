"""Image and audio headers, pixels and samples.

Metadata and pixels are separate functions, so a query that wants sizes only
never decodes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

META = "struct<format: string, width: bigint, height: bigint, offset_x: int, offset_y: int, bpp: int>"
IMAGE = "struct<width: int, height: int, pixel_format: string, pixels: binary, palette: array<int>, offset_x: int, offset_y: int, error: string>"
WAVE = "struct<format_tag: int, channels: int, samples_per_second: bigint, average_bytes_per_second: bigint, block_align: int, bits_per_sample: int, pcm_offset: bigint, pcm_size: bigint, source_format: string>"


def metadata(b: bytes) -> dict | None:
    """format, width, height, offsets and bits a pixel from an image's head; None if it is none that is known."""
    u = struct.unpack_from
    out = lambda f, w, h, bpp, x=0, y=0: {"format": f, "width": w, "height": abs(h), "offset_x": x, "offset_y": y, "bpp": bpp}
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, depth, kind = u(">IIBB", b, 16)
        x = y = 0
        at = 33
        while at + 8 <= len(b):
            n, name = u(">I4s", b, at)
            if name == b"oFFs":
                x, y = u(">ii", b, at + 8)
            if name in (b"IDAT", b"IEND"):
                break
            at += 12 + n
        return out("PNG", w, h, depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind], x, y)
    if b[:2] == b"BM" and len(b) >= 30:
        size = u("<I", b, 14)[0]
        if size == 12:
            w, h, _, bpp = u("<HHHH", b, 18)
        else:
            w, h, _, bpp = u("<iiHH", b, 18)
        return out("BMP", w, h, bpp)
    if b[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 < len(b) and b[at] == 0xFF:
            if 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
                depth, h, w, n = u(">BHHB", b, at + 4)
                return out("JPEG", w, h, depth * n)
            at += 2 + u(">H", b, at + 2)[0]
        return None
    if b[:4] == b"GIF8":
        w, h, f = u("<HHB", b, 6)
        return out("GIF", w, h, (f & 7) + 1)
    if b[:4] in (b"II*\0", b"MM\0*"):
        e = "<" if b[:2] == b"II" else ">"
        at = u(e + "I", b, 4)[0]
        tags = {}
        for i in range(u(e + "H", b, at)[0]):
            t, kind, n = u(e + "HHI", b, at + 2 + 12 * i)
            tags[t] = (u(e + "H", b, at + 10 + 12 * i)[0] if kind == 3 else u(e + "I", b, at + 10 + 12 * i)[0], n)
        bits = tags.get(258, (1, 1))
        return out("TIFF", tags[256][0], tags[257][0], 8 * bits[1] if bits[1] > 2 else bits[0] * tags.get(277, (1, 1))[0])
    if b[:4] == b"8BPS":
        n, h, w, depth = u(">HIIH", b, 12)
        return out("PSD", w, h, n * depth)
    if b[:4] == b"DDS ":
        h, w = u("<II", b, 12)
        return out("DDS", w, h, u("<I", b, 88)[0] or 32)
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        kind = b[12:16]
        if kind == b"VP8 ":
            w, h = u("<HH", b, 26)
            return out("WEBP", w & 0x3FFF, h & 0x3FFF, 24)
        if kind == b"VP8L":
            v = u("<I", b, 21)[0]
            return out("WEBP", (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1, 32)
        if kind == b"VP8X":
            return out("WEBP", int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1, 32 if b[20] & 16 else 24)
        return None
    if len(b) >= 18 and b[1] in (0, 1) and b[2] in (1, 2, 3, 9, 10, 11) and b[16] in (8, 15, 16, 24, 32):
        x, y, w, h, bpp = u("<hhHHB", b, 8)
        return out("TGA", w, h, bpp, x, y)
    return None


def image_metadata(content: Column) -> Column:
    @F.udf(META, useArrow=True)
    def run(b):
        try:
            return None if b is None else metadata(bytes(b))
        except Exception:  # noqa: BLE001  a truncated head
            return None

    return run(content)


#: fixed values of the format: first column and row, and steps, of the seven passes of an interlaced image
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(raw: np.ndarray, n: int) -> np.ndarray:
    """Rows without their filter byte; n is the number of bytes from a sample to the one left of it."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    size = out.shape[1]
    for y in range(len(raw)):
        f, row = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros(size, np.int32)
        if f == 0:
            out[y] = row
        elif f == 2:
            out[y] = row + up & 255
        elif f == 1:
            wide = np.zeros(-(-size // n) * n, np.int32)
            wide[:size] = row
            out[y] = np.cumsum(wide.reshape(-1, n), axis=0).reshape(-1)[:size] & 255
        elif f in (3, 4):
            cur, above = [0] * size, up.tolist()
            for i, x in enumerate(row.tolist()):
                a, c = (cur[i - n], above[i - n]) if i >= n else (0, 0)
                if f == 3:
                    cur[i] = x + (a + above[i]) // 2 & 255
                else:
                    p = a + above[i] - c
                    pa, pb, pc = abs(p - a), abs(p - above[i]), abs(p - c)
                    cur[i] = x + (a if pa <= pb and pa <= pc else above[i] if pb <= pc else c) & 255
            out[y] = cur
        else:
            raise ValueError(f"filter {f}")
    return out


def _samples(data: np.ndarray, w: int, h: int, n: int, depth: int, indexed: bool) -> tuple[np.ndarray, int]:
    """h x w x n samples of eight bits from the packed rows of one pass, and the bytes used."""
    stride = -(-w * n * depth // 8)
    used = h * (stride + 1)
    rows = _unfiltered(data[:used].reshape(h, stride + 1), max(1, n * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]  # the high byte
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = bits @ (1 << np.arange(depth)[::-1])
        rows = (rows if indexed else rows * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return rows[:, : w * n].reshape(h, w, n), used


def decode_png(b: bytes):
    w, h, depth, kind, _, _, lace = struct.unpack_from(">IIBBBBB", b, 16)
    if kind not in (0, 2, 3, 4, 6) or depth not in (1, 2, 4, 8, 16):
        raise ValueError("no such kind of pixels")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    data, palette, at = b"", None, 8
    while at + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, at)
        if name == b"IDAT":
            data += b[at + 8 : at + 8 + size]
        elif name == b"PLTE":
            p = np.frombuffer(b[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3).astype(np.int64)
            palette = [int(x) - (1 << 32) for x in (0xFF000000 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2])]
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    if lace:
        px, at = np.zeros((h, w, n), np.uint8), 0
        for x, y, right, down in _PASSES:
            pw, ph = max(0, -(-(w - x) // right)), max(0, -(-(h - y) // down))
            if pw and ph:
                px[y::down, x::right], used = _samples(raw[at:], pw, ph, n, depth, kind == 3)
                at += used
    else:
        px, _ = _samples(raw, w, h, n, depth, kind == 3)
    if kind == 2:
        return "bgr24", px[:, :, ::-1], palette
    if kind == 6:
        return "bgra32", px[:, :, [2, 1, 0, 3]], palette
    if kind == 4:
        return "bgra32", px[:, :, [0, 0, 0, 1]], palette
    return ("indexed8" if kind == 3 else "gray8"), px, palette


def decode_bmp(b: bytes):
    start = struct.unpack_from("<I", b, 10)[0]
    w, h, _, bpp, packed = struct.unpack_from("<iiHHI", b, 18)
    if packed not in (0, 3) or bpp not in (8, 24, 32):
        raise ValueError("packed bitmap")
    n, stride = bpp // 8, (w * bpp // 8 + 3) & ~3
    px = np.frombuffer(b, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * n].reshape(abs(h), w, n)
    palette = None
    if bpp == 8:
        p = np.frombuffer(b[54:start], "<u4").astype(np.int64) | 0xFF000000
        palette = [int(x) - (1 << 32) for x in p]
    return {8: "indexed8", 24: "bgr24", 32: "bgr32"}[bpp], (px[::-1] if h > 0 else px), palette


def decode_tga(b: bytes):
    skip, mapped, kind = b[0], b[1], b[2]
    w, h, bpp, flags = struct.unpack_from("<HHBB", b, 12)
    if mapped or kind not in (2, 3, 10, 11) or bpp not in (8, 24, 32):
        raise ValueError("unknown kind")
    n, at = bpp // 8, 18 + skip
    if kind < 8:
        px = np.frombuffer(b, np.uint8, w * h * n, at)
    else:
        out = bytearray()
        while len(out) < w * h * n:
            c = b[at]
            if c & 128:
                out += b[at + 1 : at + 1 + n] * (c - 127)
                at += 1 + n
            else:
                out += b[at + 1 : at + 1 + n * (c + 1)]
                at += 1 + n * (c + 1)
        px = np.frombuffer(bytes(out[: w * h * n]), np.uint8)
    px = px.reshape(h, w, n)
    return {8: "gray8", 24: "bgr24", 32: "bgra32"}[bpp], (px if flags & 32 else px[::-1]), None


DECODE = {"PNG": decode_png, "BMP": decode_bmp, "TGA": decode_tga}


def decode_image(b: bytes) -> dict:
    m = metadata(b)
    if m is None or m["format"] not in DECODE:
        raise ValueError("no decoder for " + (m["format"] if m else "this"))
    fmt, px, palette = DECODE[m["format"]](b)
    return {"width": px.shape[1], "height": px.shape[0], "pixel_format": fmt, "pixels": px.tobytes(), "palette": palette, "offset_x": m["offset_x"], "offset_y": m["offset_y"], "error": None}


def image(content: Column) -> Column:
    """Pixels; a null image with the reason in error where it cannot be decoded."""

    @F.udf(IMAGE, useArrow=True)
    def run(b):
        try:
            return None if b is None else decode_image(bytes(b))
        except Exception as e:  # noqa: BLE001
            return {"error": f"{type(e).__name__}: {e}"}

    return run(content)


_SIZES = {"gray8": 1, "indexed8": 1, "bgr24": 3, "bgr32": 4, "bgra32": 4}


def encode_image(i: dict, to: str) -> bytes:
    w, h, f = i["width"], i["height"], i["pixel_format"]
    px = np.frombuffer(i["pixels"], np.uint8).reshape(h, w, _SIZES[f])
    pal = [p & 0xFFFFFF for p in i["palette"] or []] if f == "indexed8" else [x * 0x10101 for x in range(256)]
    if to == "BMP":
        n = px.shape[2]
        stride = (w * n + 3) & ~3
        rows = np.zeros((h, stride), np.uint8)
        rows[:, : w * n] = px[::-1].reshape(h, w * n)
        table = b"".join(struct.pack("<I", p) for p in (pal + [0] * 256)[:256]) if n == 1 else b""
        start = 54 + len(table)
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + rows.size, 0, start, 40, w, h, 1, 8 * n, 0, rows.size, 2835, 2835, 256 if n == 1 else 0, 0) + table + rows.tobytes()
    if to == "PNG":
        kind = {"gray8": 0, "indexed8": 3, "bgr24": 2, "bgr32": 2, "bgra32": 6}[f]
        px = {0: lambda: px, 3: lambda: px, 2: lambda: px[:, :, 2::-1], 6: lambda: px[:, :, [2, 1, 0, 3]]}[kind]()
        rows = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, -1)], axis=1)
        chunk = lambda name, d: struct.pack(">I", len(d)) + name + d + struct.pack(">I", zlib.crc32(name + d))
        head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
        table = chunk(b"PLTE", b"".join(p.to_bytes(3, "big") for p in pal)) if kind == 3 else b""
        place = chunk(b"oFFs", struct.pack(">iiB", i["offset_x"], i["offset_y"], 0)) if i.get("offset_x") or i.get("offset_y") else b""
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + place + table + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
    if to == "TGA":
        n = px.shape[2]
        if f == "indexed8":
            raise ValueError("no palette in this writer")
        return struct.pack("<BBBHHBhhHHBB", 0, 0, 3 if n == 1 else 2, 0, 0, 0, i.get("offset_x") or 0, i.get("offset_y") or 0, w, h, 8 * n, 32 | (8 if f == "bgra32" else 0)) + px.tobytes()
    raise ValueError(f"no encoder for {to}")


def convert_image(content: Column, to: str) -> Column:
    """struct(data, error): the image in another format; one that is in it already stays byte for byte."""

    @F.udf("struct<data: binary, error: string>", useArrow=True)
    def run(b):
        try:
            if b is None:
                return None
            b = bytes(b)
            m = metadata(b)
            return (b if m and m["format"] == to else encode_image(decode_image(b), to), None)
        except Exception as e:  # noqa: BLE001
            return (None, f"{type(e).__name__}: {e}")

    return run(content)


def wave_info(b: bytes) -> dict | None:
    """Header of a wave, Ogg Vorbis, MP3 or AIFF file."""
    u = struct.unpack_from
    if b[:4] == b"RIFF" and b[8:12] == b"WAVE":
        at, fmt = 12, None
        while at + 8 <= len(b):
            name, n = u("<4sI", b, at)
            if name == b"fmt ":
                fmt = u("<HHIIHH", b, at + 8)
            if name == b"data" and fmt:
                keys = ("format_tag", "channels", "samples_per_second", "average_bytes_per_second", "block_align", "bits_per_sample")
                return dict(zip(keys, fmt)) | {"pcm_offset": at + 8, "pcm_size": min(n, len(b) - at - 8), "source_format": "wav"}
            at += 8 + n + (n & 1)
        return None
    if b[:4] == b"OggS":
        at = 27 + b[26]
        if b[at : at + 7] == b"\x01vorbis":
            ch, rate, _, nominal, _ = u("<BIiii", b, at + 11)
            return {"format_tag": 1, "channels": ch, "samples_per_second": rate, "average_bytes_per_second": max(nominal, 0) // 8, "block_align": 2 * ch, "bits_per_sample": 16, "pcm_offset": None, "pcm_size": None, "source_format": "ogg"}
        return None
    if b[:4] == b"FORM" and b[8:12] in (b"AIFF", b"AIFC"):
        at = 12
        while at + 8 <= len(b):
            name, n = u(">4sI", b, at)
            if name == b"COMM":
                ch, frames, bits = u(">hIh", b, at + 8)
                e, m = u(">HQ", b, at + 16)
                rate = int(m * 2.0 ** ((e & 0x7FFF) - 16383 - 63))
                return {"format_tag": 1, "channels": ch, "samples_per_second": rate, "average_bytes_per_second": rate * ch * bits // 8, "block_align": ch * bits // 8, "bits_per_sample": bits, "pcm_offset": None, "pcm_size": frames * ch * bits // 8, "source_format": "aiff"}
            at += 8 + n + (n & 1)
        return None
    at = 10 + (b[6] << 21 | b[7] << 14 | b[8] << 7 | b[9]) if b[:3] == b"ID3" and len(b) > 10 else 0
    if len(b) >= at + 4 and b[at] == 0xFF and b[at + 1] & 0xE6 == 0xE2:
        version, layer1 = b[at + 1] >> 3 & 3, b[at + 1] >> 3 & 3 == 3
        rates = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
        kbits = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320) if layer1 else (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
        r, k = b[at + 2] >> 2 & 3, b[at + 2] >> 4
        if version in rates and r < 3 and 0 < k < 15:
            ch = 1 if b[at + 3] >> 6 == 3 else 2
            return {"format_tag": 0x55, "channels": ch, "samples_per_second": rates[version][r], "average_bytes_per_second": kbits[k] * 125, "block_align": 1, "bits_per_sample": 16, "pcm_offset": None, "pcm_size": None, "source_format": "mp3"}
    return None


def audio_info(content: Column) -> Column:
    @F.udf(WAVE, useArrow=True)
    def run(b):
        try:
            return None if b is None else wave_info(bytes(b))
        except Exception:  # noqa: BLE001
            return None

    return run(content)


def encode_wav(pcm: bytes, channels: int, rate: int, bits: int) -> bytes:
    align = channels * bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0x24 + len(pcm), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * align, align, bits, b"data", len(pcm)) + pcm


def wav(pcm: Column, channels: Column, rate: Column, bits: Column) -> Column:
    """A wave file around samples, without Python: the header is packed as columns."""
    from holdfast.functions.bytesfn import pack_le

    n, align = F.octet_length(pcm), channels * F.floor(bits / 8)
    text = lambda s: F.lit(s.encode("ascii"))
    return F.concat(text("RIFF"), pack_le(n + 0x24, 4), text("WAVEfmt "), pack_le(F.lit(16), 4), pack_le(F.lit(1), 2), pack_le(channels, 2), pack_le(rate, 4), pack_le(rate * align, 4), pack_le(align, 2), pack_le(bits, 2), text("data"), pack_le(n, 4), pcm)
