import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from holdfast.functions import bytesfn as bf
from holdfast.functions import codecs, media, rangecoder, text  # noqa: F401

RNG = random.Random(9)
SAMPLES = [b"", b"a", b"abcabcabcabcabcabc" * 9, bytes(range(256)) * 3, bytes(5000), bytes(RNG.randrange(4) for _ in range(3000)), RNG.randbytes(2000), "ことば テスト".encode("cp932") * 20]


@pytest.mark.parametrize("name", ["zlib", "deflate", "gzip", "bz2", "zstd", "lzma", "lzss", "lz4_block", "rle", "mtf", "range"])
def test_round_trips(name):
    for b in SAMPLES:
        assert bytes(codecs.DECODERS[name](bytes(codecs.ENCODERS[name](b)))) == b


def test_bwt_and_huffman_round_trips():
    for b in SAMPLES[:4] + [SAMPLES[5][:500]]:
        assert bytes(codecs.bwt_decode(codecs.bwt_encode(b))) == b
        if b:
            assert bytes(codecs.huffman_decode(codecs.huffman_encode(b), len(b))) == b


@pytest.mark.parametrize("name, options", [("xor", {"key": b"key"}), ("not", {}), ("add", {"n": 7}), ("rotate", {"n": 3}), ("rc4", {"key": b"Key"}), ("blowfish", {"key": b"secret"}), ("rc6", {"key": b"0123456789abcdef"}), ("mersenne_xor", {"seed": 5})])
def test_ciphers_round_trip(name, options):
    for b in SAMPLES:
        assert bytes(codecs.DECODERS[name](bytes(codecs.ENCODERS[name](b, **options)), **options)) == b


def test_published_vectors():
    assert codecs._rc4(b"Plaintext", b"Key").hex().upper() == "BBF316E8D940AF0AD3"
    assert codecs.ENCODERS["blowfish"](bytes(8), bytes(8)).hex() == "4ef997456198dd78"
    assert codecs.ENCODERS["rc6"](bytes(16), bytes(16)).hex() == "8fc3a53656b1f778c129df4e9848a41e"
    assert codecs.crc32_normal(b"123456789") == 0xFC891918 and codecs.crc16(b"123456789") == 0x31C3 and codecs.crc64(b"123456789") == 0x995DC9BBDF1939FA
    g = codecs.Mersenne(5489)
    assert [g.next() for _ in range(2)] == [3499211612, 581869302]
    assert bytes(codecs.lz4_block(b"\x1fA\x01\x00\x00\x50BCDEF")) == b"A" * 20 + b"BCDEF"
    assert bytes(codecs.lzss_decode(b"\x07abc\xee\xf0")) == b"abcabc"


def test_bad_input_gives_null_and_a_reason(spark):
    df = spark.createDataFrame([(b"not packed",), (zlib.compress(b"ok"),), (None,)], "b binary")
    got = df.select(codecs.decode("zlib")(F.col("b")).alias("d"), codecs.decode_checked("zlib")(F.col("b")).alias("c")).collect()
    assert [r["d"] and bytes(r["d"]) for r in got] == [None, b"ok", None]
    assert got[0]["c"]["error"].startswith("error") and got[1]["c"]["error"] is None


def test_byte_columns(spark):
    b = struct.pack("<HIq", 0xFFFE, 0xFFFFFFFF, -2) + b"\x7f"
    c = F.col("b")
    row = spark.createDataFrame([(b, 0x80000001)], "b binary, x bigint").select(
        bf.unsigned_le(c, 0, 2).alias("u16"), bf.signed_le(c, 0, 2).alias("i16"), bf.unsigned_le(c, 2, 4).alias("u32"), bf.signed_le(c, 2, 4).alias("i32"),
        bf.unsigned_le(c, 6, 8).alias("u64"), bf.signed_le(c, 6, 8).alias("i64"), bf.unsigned_le(c, 12, 4).alias("short"), bf.unsigned_be(c, 0, 2).alias("be"),
        bf.signed_le(c, 0, 3).alias("i24"), bf.ascii_equal(c, 14, "\x7f").alias("eq"), bf.ascii_equal(c, 14, "xx").alias("ne"), bf.rotate_left(F.col("x"), 1, 32).alias("rl"), bf.rotate_right(F.col("x"), 1, 32).alias("rr"),
        bf.byte_swap(F.col("x"), 4).alias("swap"), bf.pack_le(F.col("x"), 4).alias("le"), bf.find_bytes(c, b"\x7f").alias("at"), bf.find_bytes(c, b"zz").alias("no"), bf.rotate_left_64(F.lit(-(2**63)), 1).alias("r64"), bf.member(c, 14, 5).alias("m"),
    ).first()
    assert (row.u16, row.i16, row.u32, row.i32, int(row.u64), row.i64, row.short, row.be) == (0xFFFE, -2, 0xFFFFFFFF, -1, 2**64 - 2, -2, None, 0xFEFF)
    assert row.i24 == int.from_bytes(b[:3], "little", signed=True) and row.eq and not row.ne and row.rl == 3 and row.rr == 0xC0000000
    assert row.swap == 0x01000080 and bytes(row.le) == b"\x01\0\0\x80" and row["at"] == 14 and row.no == -1 and row.r64 == 1 and bytes(row.m) == b"\x7f"


def test_charsets(spark):
    sjis = "テストABC".encode("cp932")
    df = spark.createDataFrame([(sjis + b"\0rest", "名前"), (b"\xff\xfeA\0", "é")], "b binary, s string")
    got = df.select(text.c_string(F.col("b")).alias("c"), text.encode_strict(F.col("s")).alias("e"), text.lower_sjis(F.col("b")).alias("l"), text.guess_encoding(F.col("b")).alias("g")).collect()
    assert got[0]["c"] == "テストABC" and bytes(got[0]["e"]) == "名前".encode("cp932") and bytes(got[0]["l"]) == "テストabc".encode("cp932") + b"\0rest"
    assert got[1]["e"] is None and got[1]["g"] == "utf-16le" and got[0]["g"] == "default"


def test_aes(spark):
    df = spark.createDataFrame([(b"hello", b"0" * 16, b"1" * 16)], "b binary, k binary, iv binary")
    enc = df.select("k", "iv", F.expr("substring(aes_encrypt(b, k, 'CBC', 'PKCS', iv), 17)").alias("e"))
    assert bytes(enc.select(codecs.aes_cbc_decrypt(F.col("e"), F.col("k"), F.col("iv")).alias("d")).first().d) == b"hello"


def image(fmt="bgr24", n=3, w=5, h=4):
    return {"width": w, "height": h, "pixel_format": fmt, "pixels": RNG.randbytes(w * h * n), "palette": [0x10101 * i for i in range(256)] if fmt == "indexed8" else None, "offset_x": 3, "offset_y": -2}


@pytest.mark.parametrize("fmt, n, to", [("bgr24", 3, "PNG"), ("bgra32", 4, "PNG"), ("gray8", 1, "PNG"), ("indexed8", 1, "PNG"), ("bgr24", 3, "BMP"), ("indexed8", 1, "BMP"), ("bgr24", 3, "TGA"), ("bgra32", 4, "TGA"), ("gray8", 1, "TGA")])
def test_images_round_trip(fmt, n, to):
    i = image(fmt, n)
    b = media.encode_image(i, to)
    m, back = media.metadata(b), media.decode_image(b)
    assert (m["format"], m["width"], m["height"]) == (to, 5, 4) and back["pixels"] == i["pixels"] and back["pixel_format"] == fmt
    if to != "BMP":
        assert (m["offset_x"], m["offset_y"]) == (3, -2)


def test_png_filters():
    import numpy as np

    w, h, px = 4, 5, np.array(list(RNG.randbytes(60)), np.uint8).reshape(5, 12)
    rows = []
    for y in range(h):
        f = y % 5
        up = px[y - 1].astype(int) if y else np.zeros(12, int)
        left = np.concatenate([np.zeros(3, int), px[y][:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        rows.append(bytes([f]) + ((px[y] - [0, left, up, (left + up) // 2, paeth][f]) & 255).astype(np.uint8).tobytes())
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    b = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert media.decode_image(b)["pixels"] == px.reshape(h, w, 3)[:, :, ::-1].tobytes()


def test_heads(spark):
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x07\0\x09\x03" + bytes(20)
    gif = b"GIF89a" + struct.pack("<HHB", 10, 20, 0xF7) + bytes(10)
    psd = b"8BPS\0\1" + bytes(6) + struct.pack(">HIIH", 4, 30, 40, 8)
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 3) + struct.pack("<HHII", 256, 4, 1, 11) + struct.pack("<HHII", 257, 4, 1, 12) + struct.pack("<HHII", 258, 3, 1, 8) + bytes(4)
    wav = media.encode_wav(b"\1\2\3\4", 2, 44100, 16)
    df = spark.createDataFrame([(jpeg,), (gif,), (psd,), (tiff,), (wav,), (b"junk",), (None,)], "b binary").select(media.image_metadata(F.col("b")).alias("m"), media.audio_info(F.col("b")).alias("a"))
    got = df.collect()
    assert [(r["m"]["format"], r["m"]["width"], r["m"]["height"], r["m"]["bpp"]) if r["m"] else None for r in got] == [("JPEG", 9, 7, 24), ("GIF", 10, 20, 8), ("PSD", 40, 30, 32), ("TIFF", 11, 12, 8), None, None, None]
    assert (got[4]["a"]["channels"], got[4]["a"]["pcm_offset"], got[4]["a"]["pcm_size"]) == (2, 44, 4)
    made = spark.createDataFrame([(b"\1\2\3\4",)], "p binary").select(media.wav(F.col("p"), F.lit(2), F.lit(44100), F.lit(16)).alias("w")).first()
    assert bytes(made.w) == wav


def test_scripts_and_tables(spark):
    import json

    from holdfast.functions import script

    b = "一行目\r\n\r\nthree".encode("cp932")
    df = spark.createDataFrame([(b,), (b"\0\1binary",)], "b binary").select(script.is_script(F.col("b")).alias("s"), script.read_lines(F.col("b")).alias("l"))
    r = df.collect()
    assert r[0]["s"] and not r[1]["s"] and [(x["id"], x["text"]) for x in r[0]["l"]] == [(0, "一行目"), (2, "three")]
    back = df.limit(1).select(script.write_lines(F.col("l")).alias("w")).first()["w"]
    assert bytes(back) == b.replace(b"\r\n", b"\n")
    t = spark.createDataFrame([('a = { x = 1, "two", { -3.5, true } }, -- note\n b = nil',), ("{ broken",), (None,)], "s string").select(script.table_as_json(F.col("s")).alias("j")).collect()
    assert json.loads(t[0]["j"]) == {"a": {"x": 1, "1": "two", "2": [-3.5, True]}, "b": None} and t[1]["j"] is None and t[2]["j"] is None


def test_palettes(spark):
    from holdfast.functions.palette import ORDERS, read_palette

    b = bytes([9, 1, 2, 3, 4, 5, 6, 7, 8])
    df = spark.createDataFrame([(b,)], "b binary").select(*[read_palette(F.col("b"), 1, 2, o).alias(o) for o in ORDERS]).first()
    u = lambda x: x & 0xFFFFFFFF
    assert u(df["rgb"][0]) == 0xFF010203 and u(df["bgr"][1]) == 0xFF060504 and u(df["bgra"][1]) == 0x08070605 and u(df["rgbx"][0]) == 0xFF010203


def test_checksums_of_batches():
    """The batch forms equal a bit-by-bit division, whatever the lengths."""

    def divide(b, poly, mask):
        c = mask
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ poly if c & 1 else c >> 1
        return c ^ mask

    values = [bytes(RNG.randrange(256) for _ in range(n)) for n in [0, 1, 2, 300, 7, 7, 0, 64, *range(30)]]
    assert codecs.crc64_of(values) == [divide(v, 0xC96C5795D7870F42, 2**64 - 1) for v in values]
    assert codecs.crc64_of([]) == []

    def first_bit(b, poly, bits, c):
        for x in b:
            c ^= x << bits - 8
            for _ in range(8):
                c = (c << 1 ^ poly if c >> bits - 1 else c << 1) & (1 << bits) - 1
        return c

    assert [codecs.crc32_normal(v) for v in values] == [first_bit(v, 0x04C11DB7, 32, 2**32 - 1) ^ 2**32 - 1 for v in values]
    assert [codecs.crc16(v) for v in values] == [first_bit(v, 0x1021, 16, 0) for v in values]


def test_sliding_window_by_the_letter():
    """Slices of the output give what a ring of the frame's size gives, byte by byte."""

    def ring_decode(b, frame, start, fill):
        ring, at, out, i = bytearray([fill]) * frame, start, bytearray(), 0
        while i < len(b):
            flags, i = b[i], i + 1
            for bit in range(8):
                if i >= len(b):
                    return out
                if flags >> bit & 1:
                    got, i = b[i : i + 1], i + 1
                    ring[at], at = got[0], (at + 1) % frame
                    out += got
                elif i + 1 >= len(b):
                    return out
                else:
                    src, n, i = b[i] | (b[i + 1] & 0xF0) << 4, (b[i + 1] & 0xF) + 3, i + 2
                    for k in range(n):
                        ring[at] = ring[(src + k) % frame]
                        out.append(ring[at])
                        at = (at + 1) % frame
        return out

    for _ in range(60):
        b = bytes(RNG.choice([RNG.randrange(256), 0xFF, 0x0F]) for _ in range(RNG.randrange(400)))
        assert codecs.lzss_decode(b, fill=0x20) == ring_decode(b, 0x1000, 0xFEE, 0x20)


def test_picture_of_steps():
    """Width 2, height 2, one value a plane and no steps: three planes of one shade."""
    bits = ""
    for shade in (10, 20, 30):
        bits += f"{shade:08b}" + "000"
    bits += "0" * (-len(bits) % 8)
    b = (2).to_bytes(2, "big") * 2 + int(bits, 2).to_bytes(len(bits) // 8, "big")
    got = codecs.DECODERS["spb"](b)
    assert got[:2] == b"BM" and got[54:62] == bytes((10, 20, 30, 10, 20, 30, 0, 0)) and len(got) == 54 + 16
    packed = (5).to_bytes(4, "big") + __import__("bz2").compress(b"hello")
    assert codecs.DECODERS["nbz"](packed) == b"hello"


def test_joins_of_wide_intervals(spark):
    from holdfast.operators import layout

    r = random.Random(4)
    a = [(i, 0, s := r.randrange(5000), s + r.choice([0, 1, 5, 300, 4000, 10**9])) for i in range(60)]
    b = [(i, 0, s := r.randrange(5000), s + r.choice([0, 2, 40, 1000, 10**12])) for i in range(60)]
    x, y = spark.createDataFrame(a, "i long, k long, s long, e long"), spark.createDataFrame(b, "j long, k long, t long, u long")
    got = sorted((v["i"], v["j"]) for v in layout.overlap_join(x, y, ["k"], ("s", "e"), ("t", "u"), 8).collect())
    assert got == sorted((i, j) for i, _, s, e in a for j, _, t, u in b if s < u and t < e and s < e and t < u)
    got = sorted((v["i"], v["j"]) for v in layout.contain_join(x, y, ["k"], "s", ("t", "u"), 8).collect())
    assert got == sorted((i, j) for i, _, s, _ in a for j, _, t, u in b if t <= s < u)
    sized = layout.strict_lead_size(x.select("i", "k", "s").withColumn("end", F.lit(9999).cast("long")), ["k"], "s", "end")
    starts = sorted({v[2] for v in a})
    assert {(v["i"], v["size"]) for v in sized.collect()} == {(i, min([t for t in starts if t > s], default=9999) - s) for i, _, s, _ in a}


def test_png_of_other_depths():
    """Written here sample by sample: 1, 2, 4 and 16 bits, with palette, and in seven passes."""
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))

    def png(w, h, depth, kind, rows, lace=0, extra=b""):
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, lace)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    def packed(values, depth):
        bits = "".join(f"{v:0{depth}b}" for v in values)
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")

    r = random.Random(5)
    for depth in (1, 2, 4, 8, 16):
        w, h = 11, 5
        px = [[r.randrange(1 << depth) for _ in range(w)] for _ in range(h)]
        kind, got, _ = media.decode_png(png(w, h, depth, 0, b"".join(b"\0" + packed(row, depth) for row in px)))
        want = [[v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1) for v in row] for row in px]
        assert kind == "gray8" and got[:, :, 0].tolist() == want, depth
        passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
        laced = b"".join(b"\0" + packed(px[y][x0::dx], depth) for x0, y0, dx, dy in passes if x0 < w for y in range(y0, h, dy))
        assert media.decode_png(png(w, h, depth, 0, laced, 1))[1][:, :, 0].tolist() == want, depth
    px = [[r.randrange(4) for _ in range(7)] for _ in range(3)]
    plte = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]))
    kind, got, palette = media.decode_png(png(7, 3, 2, 3, b"".join(b"\0" + packed(row, 2) for row in px), 0, plte))
    assert kind == "indexed8" and got[:, :, 0].tolist() == px and palette[1] & 0xFFFFFF == 0x040506
    wide = [[[r.randrange(65536) for _ in range(3)] for _ in range(4)] for _ in range(3)]
    rows = [b"".join(struct.pack(">HHH", *v) for v in row) for row in wide]
    filtered, before = b"", bytes(24)
    for i, row in enumerate(rows):
        f = i + 1
        left = bytes(6) + row[:-6]
        guess = [left, before, bytes((x + y) // 2 for x, y in zip(left, before))][i]
        filtered, before = filtered + bytes([f]) + bytes((x - y) & 255 for x, y in zip(row, guess)), row
    kind, got, _ = media.decode_png(png(4, 3, 16, 2, filtered))
    assert kind == "bgr24" and got.tolist() == [[[v >> 8 for v in p[::-1]] for p in row] for row in wide]
