import sqlite3
import struct
import zlib

from pyspark.sql import functions as F

from holdfast.functions import media
from holdfast.operators import sink
from holdfast.sources import containers as cs
from holdfast.sources import files
from holdfast.streaming import watch
from tests.test_functions import image

MEMBERS = [("a.txt", b"hello " * 50), ("img/b.png", media.encode_image(image(), "PNG")), ("c.dat", b""), ("名前.bin", bytes(range(256)) * 4)]
SHORT = [("a.txt", b"x" * 100), ("b.txt", b"yy"), ("c.png", b"zzz")]


def rows(spark, members, archive="one"):
    return spark.createDataFrame([(archive, i, n, d) for i, (n, d) in enumerate(members)], "archive string, ord int, name string, data binary")


def test_every_writer_is_read_back(spark):
    for tag in [*sink.WRITERS, *cs.LAYOUTS]:
        members = SHORT if tag == "WILL" else [m for m in MEMBERS if m[1] or not tag.startswith("GENERIC")]
        writer = sink.build_layout(cs.LAYOUTS[tag]) if tag in cs.LAYOUTS else None
        made = sink.build(rows(spark, members).unionByName(rows(spark, members[:2], "two")), tag, writer)
        assert [r["error"] for r in made.collect()] == [None, None], tag
        f = made.select(F.col("archive").alias("path"), "content")
        listed = cs.list_members(f, [tag])
        got = cs.open_members(listed, f).collect()
        for archive, want in (("one", members), ("two", members[:2])):
            own = {r["name"]: bytes(r["data"]) for r in got if r["path"] == archive}
            assert own == dict(want), (tag, archive)


def test_dispatch_over_readers_and_bad_files(spark):
    z = sink.build_zip(MEMBERS)
    bad = [b"", b"PK\5\6", b"PACK" + struct.pack("<I", 0x50000), b"PACK" + struct.pack("<I", 2) + bytes(20), b"XP3\r\n \n\x1a\x8bg\x01" + bytes(4), z[:-30], cs.LAYOUTS["GENERIC/PACK"].magic + struct.pack("<I", 1) + b"n".ljust(32, b"\0") + struct.pack("<II", 9999, 5)]
    f = spark.createDataFrame([(f"p{i}", b) for i, b in enumerate(bad)] + [("zip", z), ("none", None)], "path string, content binary")
    got = cs.list_members(f).collect()
    assert {r["path"] for r in got if r["error"]} == {f"p{i}" for i in range(len(bad))} | {"none"}
    assert [r["name"] for r in got if r["path"] == "zip"] == [n for n, _ in MEMBERS] and all(r["tag"] == "ZIP" for r in got if r["path"] == "zip")
    tagged = f.withColumn("tags", F.array(F.lit("XP3"), F.lit("ZIP")))
    assert cs.list_members(tagged).filter("tag = 'ZIP'").count() == len(MEMBERS)


def test_nested_containers(spark):
    inner = sink.build_zip([("deep.txt", b"deep")])
    outer = sink.build_xp3([("in.zip", inner), ("flat.txt", b"flat")])
    got = cs.expand(spark.createDataFrame([("o", outer)], "path string, content binary"), 3).collect()
    assert {("/".join(r["container_path"]), r["name"], bytes(r["data"])) for r in got} == {("o", "in.zip", inner), ("o", "flat.txt", b"flat"), ("o/in.zip", "deep.txt", b"deep")}


def test_multi_part_members(spark):
    whole = bytes(range(200))
    parts = spark.createDataFrame([(i, 50 * i, 50 * i + 50, whole[50 * i : 50 * i + 50]) for i in range(4)], "part_no int, start bigint, end bigint, content binary")
    e = spark.createDataFrame([("a", 0, 10), ("b", 40, 120), ("c", 199, 1)], "name string, offset bigint, size bigint")
    got = {r["name"]: bytes(r["data"]) for r in cs.split_parts(e, parts, 64).collect()}
    assert got == {"a": whole[:10], "b": whole[40:160], "c": whole[199:]}


def test_typed_tables(spark):
    strings = b"\0Name\0Size\0Data\0Const\0one\0two\0"
    at = {s: strings.index(s) for s in (b"Name", b"Size", b"Data", b"Const", b"one", b"two")}
    cols = struct.pack(">BI", 0x5A, at[b"Name"]) + struct.pack(">BI", 0x54, at[b"Size"]) + struct.pack(">BI", 0x5B, at[b"Data"]) + struct.pack(">BII", 0x34, at[b"Const"], 7)
    row = lambda n, s, o, z: struct.pack(">IIII", at[n], s, o, z)
    data_rows = row(b"one", 10, 0, 2) + row(b"two", 20, 2, 3)
    rows_at = 24 + len(cols)
    strings_at = rows_at + len(data_rows)
    body = struct.pack(">IIIIHHI", rows_at, strings_at, strings_at + len(strings), 0, 4, 16, 2) + cols + data_rows + strings + b"abcde"
    table = b"@UTF" + struct.pack(">I", len(body)) + body
    assert cs.read_utf(table) == [{"Name": "one", "Size": 10, "Data": b"ab"}, {"Name": "two", "Size": 20, "Data": b"cde"}]
    got = cs.utf_rows(spark.createDataFrame([("t", table), ("bad", b"x")], "path string, content binary")).collect()
    assert [(r["row_no"], r["row"]["Name"], r["row"]["Size"]) for r in got] == [(0, "one", "10"), (1, "two", "20")]


def test_checked_rows_and_extraction(spark, tmp_path):
    e = spark.createDataFrame([("x", 0, "a.txt", b"1"), ("x", 1, "A.TXT", b"2"), ("x", 2, "é.txt", b"3"), ("x", 3, " ", b"4"), ("x", 4, "../../up/./b.txt", b"5")], "archive string, ord int, name string, data binary")
    assert [r["problem"] for r in sink.checked(e).orderBy("ord").collect()] == [None, "duplicate", "charset", "name", None]
    got = {r["target"]: r["status"] for r in sink.extract(e.filter("ord <> 3"), str(tmp_path / "out"), "rename").collect()}
    assert got == {"a.txt": "written", "A.1.TXT": "written", "é.txt": "written", "up/b.txt": "written"}
    assert (tmp_path / "out/up/b.txt").read_bytes() == b"5" and not list(tmp_path.glob("**/*.part"))
    again = [r["status"] for r in sink.extract(e.filter("ord = 0"), str(tmp_path / "out"), "skip").collect()]
    clash = [r["status"] for r in sink.extract(e.filter("ord = 0"), str(tmp_path / "out"), "error").collect()]
    assert again == ["skipped"] and clash[0].startswith("error: FileExistsError")


def test_conversion(spark):
    png, bmp = media.encode_image(image(), "PNG"), media.encode_image(image(), "BMP")
    m = spark.createDataFrame([("a.png", "image", png), ("b.bmp", "image", bmp), ("c.txt", "script", b"t"), ("d.jpg", "image", b"\xff\xd8\xffbroken")], "name string, type string, data binary")
    got = {r["name"]: r for r in sink.convert_images(m, "PNG", "png").collect()}
    assert set(got) == {"a.png", "b.png", "c.txt", "d.jpg"} and bytes(got["a.png"]["data"]) == png and got["d.jpg"]["error"]
    assert media.decode_image(bytes(got["b.png"]["data"]))["pixels"] == media.decode_image(bmp)["pixels"]
    a = spark.createDataFrame([("x.bgm", "audio", media.encode_wav(b"\0\0", 1, 8000, 16)), ("y.raw", "audio", b"??")], "name string, type string, data binary")
    assert {r["name"]: r["ok"] for r in sink.convert_audio(a).collect()} == {"x.wav": True, "y.raw": None}


def test_files_and_side_files(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/A.ZIP").write_bytes(sink.build_zip(SHORT))
    (tmp_path / "d/b.png").write_bytes(media.encode_image(image(), "PNG"))
    (tmp_path / "d/sub/c.txt").write_bytes(b"c")
    f = files.files(spark, str(tmp_path / "d"), mask="*.zip")
    r = f.select("name", "ext", "stem", "signature", "size").first()
    assert (r["name"], r["ext"], r["stem"], r["signature"]) == ("A.ZIP", "zip", "A", 0x04034B50)
    assert files.files(spark, str(tmp_path / "d"), recursive=True).count() == 3

    (tmp_path / "list.txt").write_text("10,a.bin\n\n20,b.bin\n3F\n")
    assert [(x["offset"], x["name"], x["size"]) for x in files.offset_list(spark, str(tmp_path / "list.txt")).collect()] == [(16, "a.bin", 16), (32, "b.bin", 31)]


def test_sqlite_with_pushed_filter(spark, tmp_path):
    with sqlite3.connect(tmp_path / "i.db") as db:
        db.execute("CREATE TABLE file_infos (id INT, filepath TEXT, offset INT, archiveID INT)")
        db.executemany("INSERT INTO file_infos VALUES (?, ?, ?, ?)", [(i, f"f{i}", i * 10, i % 3) for i in range(9)])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = files.sqlite(spark, str(tmp_path / "i.db"), "file_infos", "filepath string, offset bigint, archiveID bigint")
    assert [(r["filepath"], r["offset"]) for r in df.filter("archiveID = 1").orderBy("offset").collect()] == [("f1", 10), ("f4", 40), ("f7", 70)]


def test_exe_sections(spark):
    pe = bytearray(b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HH", 0x14C, 1) + bytes(12) + struct.pack("<HH", 0, 0) + struct.pack("<8sIIII", b".text", 5, 0x1000, 8, 128) + bytes(16))
    df = spark.createDataFrame([(bytes(pe),), (b"no",)], "b binary").select(cs.exe_sections(F.col("b")).alias("s")).collect()
    assert [tuple(x) for x in df[0]["s"]] == [(".text", 0x1000, 5, 128, 8)] and df[1]["s"] is None


def test_watched_directory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.zip").write_bytes(sink.build_zip(SHORT))
    s = watch.listed(watch.watch(spark, str(tmp_path / "in"), "*.ZIP"))
    watch.run_once(s, "watched", str(tmp_path / "cp"))
    (tmp_path / "in/b.zip").write_bytes(sink.build_zip(SHORT[:1]))
    assert spark.table("watched").count() == 3


def test_index_pickles_call_nothing(spark):
    import os
    import pickle
    import zlib

    import pytest

    class Evil:
        def __reduce__(self):
            return (os.system, ("true",))

    assert cs.read_pickle(pickle.dumps({"a": [(1, 2, b"h")]}, 2)) == {"a": [(1, 2, b"h")]}
    with pytest.raises(ValueError):
        cs.read_pickle(pickle.dumps(Evil()))
    data = b"RPA-3.0 %016x %08x\n" % (40, 7)
    b = data.ljust(40, b"x") + zlib.compress(pickle.dumps({"f": [(34 ^ 7, 6 ^ 7, b"HEAD")]}, 2))
    f = spark.createDataFrame([("p", b)], "path string, content binary")
    assert bytes(cs.open_members(cs.list_members(f, ["RPA"]), f).first()["data"]) == b"HEADxxxxxx"


def test_exe_resources_and_search(spark):
    rsrc = bytearray(256)
    struct.pack_into("<HH", rsrc, 12, 0, 1)
    struct.pack_into("<II", rsrc, 16, 10, 0x80000000 | 32)
    struct.pack_into("<HH", rsrc, 32 + 12, 1, 0)
    struct.pack_into("<II", rsrc, 48, 0x80000000 | 120, 0x80000000 | 64)
    struct.pack_into("<HH", rsrc, 64 + 12, 0, 1)
    struct.pack_into("<II", rsrc, 80, 1033, 96)
    struct.pack_into("<II", rsrc, 96, 0x2000 + 140, 5)
    struct.pack_into("<H", rsrc, 120, 4)
    rsrc[122:130] = "DATA".encode("utf-16le")
    rsrc[140:145] = b"bytes"
    opt = bytearray(224)
    struct.pack_into("<H", opt, 0, 0x10B)
    struct.pack_into("<I", opt, 96 + 16, 0x2000)
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HH", 0x14C, 1) + bytes(12) + struct.pack("<HH", 224, 0) + bytes(opt)
    at = len(head) + 40
    pe = head + struct.pack("<8sIIII", b".rsrc", 256, 0x2000, 256, at) + bytes(16) + bytes(rsrc)
    df = spark.createDataFrame([(pe,)], "b binary").select(cs.exe_resources(F.col("b")).alias("r"), cs.exe_find(F.col("b"), ".rsrc", b"bytes").alias("at"), cs.exe_find(F.col("b"), ".none", b"x").alias("no")).first()
    assert [tuple(x) for x in df["r"]] == [("#10", "DATA", at + 140, 5)] and df["at"] == at + 140 and df["no"] == -1


def test_manifest(spark, tmp_path):
    (tmp_path / "v.xml").write_text('<Update><Release><Version>1.5</Version><Url>http://a</Url><Notes>n</Notes></Release><FormatsData><FileVersion>99</FileVersion><Url>http://b</Url><Requires><Assembly Name="A" Version="1.0"/><Assembly Name="B" Version="2.0"/></Requires></FormatsData></Update>')
    got = files.manifest(spark, str(tmp_path / "v.xml")).collect()
    assert [(r["Version"], r["file_version"], r["assembly"], r["needs"]) for r in got] == [("1.5", "99", "A", "1.0"), ("1.5", "99", "B", "2.0")]


def test_directory_listing(spark, tmp_path):
    for n in ("b.txt", "A.txt", "sub/x.txt", "sub/y/z.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    assert [(r["name"], r["kind"]) for r in files.listing(spark, str(tmp_path)).collect()] == [("sub", "directory"), ("A.txt", "file"), ("b.txt", "file")]


def test_layouts_that_are_data_round_trip():
    import pytest

    from holdfast.sources.layouts import LAYOUTS

    members = [("a.txt", b"x" * 100), ("b.png", b"yy"), ("c", b"zzz")]
    for tag, layout in LAYOUTS.items():
        if layout.offset is None and isinstance(layout.base, int):
            body = b"".join(d for _, d in members)
            head = bytearray(layout.magic.ljust(layout.base, b"\0"))
            head[layout.count[0] : layout.count[0] + layout.count[1]] = len(members).to_bytes(layout.count[1], "little")
            head[layout.records[0] : layout.records[0] + 4] = (layout.base + len(body)).to_bytes(4, "little")
            records = b"".join(n.encode().ljust(layout.size[0], b"\0") + struct.pack("<I", len(d)) for n, d in members)
            made = bytes(head) + body + records
        else:
            made = sink.build_layout(layout)(members)
        got = list(layout.list(made))
        assert [(r["name"], made[r["offset"] : r["offset"] + r["size"]]) for r in got] == members, tag
        for bad in (b"", made[: len(layout.magic) + 3], b"?" * 64):
            with pytest.raises((ValueError, IndexError)):
                list(layout.list(bad))


def test_opened_equals_listed(spark):
    """Every member that is listed comes back: with data, or with the reason why not."""
    z = bytearray(sink.build_zip([("good.txt", b"good " * 40), ("bad.txt", b"abcd" * 99), ("odd.txt", b"method" * 9)]))
    at = [i for i in range(len(z)) if z[i : i + 4] == b"PK\1\2"]
    z[at[2] + 10 : at[2] + 12] = (97).to_bytes(2, "little")
    data = z.index(b"bad.txt") + len("bad.txt")
    z[data : data + 6] = b"\xff" * 6
    f = spark.createDataFrame([("z", bytes(z))], "path string, content binary")
    listed = cs.list_members(f, ["ZIP"])
    got = {r["name"]: r for r in cs.open_members(listed, f).collect()}
    assert set(got) == {r["name"] for r in listed.collect()} == {"good.txt", "bad.txt", "odd.txt"}
    assert bytes(got["good.txt"]["data"]) == b"good " * 40 and got["good.txt"]["error"] is None
    assert got["bad.txt"]["data"] is None and "error" in got["bad.txt"]["error"]
    assert got["odd.txt"]["data"] is None and got["odd.txt"]["error"] == "no decoder for method97"
    gone = cs.open_members(listed, f.limit(0)).collect()
    assert len(gone) == 3 and all(r["error"] in ("no content", "no decoder for method97") for r in gone)


def test_64_bit_zip(spark):
    """Hand-made: sizes and place in the extra field, the count in the 64-bit end record."""
    body, name = b"wide", b"w.bin"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 0) + name + body
    extra = struct.pack("<HHQQQ", 1, 24, 4, 4, 0)
    central = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    wide = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<IIQI", 0x07064B50, 0, len(local) + len(central), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    f = spark.createDataFrame([("z", local + central + wide + locator + end)], "path string, content binary")
    r = cs.open_members(cs.list_members(f, ["ZIP"]), f).first()
    assert (r["name"], r["offset"], r["size"], bytes(r["data"])) == ("w.bin", 35, 4, b"wide")


def test_extract_reports_every_member(spark, tmp_path):
    schema = "name string, ord int, data binary, error string"
    members = [("a.txt", 0, b"one", None), ("A.TXT", 1, b"two", None), ("none.bin", 2, None, "bad stream"), ("why.bin", 3, None, None), (None, 4, b"x", None)]
    df = spark.createDataFrame(members, schema)
    for policy, want, kept in (("error", ["written", "error: FileExistsError"], b"one"), ("skip", ["written", "skipped"], b"one"), ("overwrite", ["overwritten", "written"], b"two")):
        to = tmp_path / policy
        got = sorted(((r["name"] or "", r["status"]) for r in sink.extract(df, str(to), policy).collect()))
        assert len(got) == 5
        status = dict(got)
        assert status["a.txt"].startswith(want[0]) and status["A.TXT"].startswith(want[1]), (policy, status)
        assert status["none.bin"] == "error: bad stream" and status["why.bin"] == "error: not decoded" and status[""].startswith("error")
        assert [p.read_bytes() for p in to.iterdir()] == [kept]


def test_large_files_are_rows(spark, tmp_path):
    (tmp_path / "big.bin").write_bytes(b"x" * 100)
    (tmp_path / "small.bin").write_bytes(b"y")
    got = {r["name"]: (r["length"], r["content"], r["error"]) for r in files.files(spark, str(tmp_path), max_file=50).collect()}
    assert got["small.bin"] == (1, bytearray(b"y"), None)
    assert got["big.bin"] == (100, None, "over 50 bytes")


def utf(columns, rows):
    """A typed table by hand: columns (name, kind), kinds 4 (u32), 6 (u64), 10 (text), 11 (bytes)."""
    strings, data = b"<NULL>\0", b""

    def text(x):
        nonlocal strings
        strings += x.encode() + b"\0"
        return struct.pack(">I", len(strings) - len(x.encode()) - 1)

    heads = b"".join(bytes([0x50 | k]) + text(n) for n, k in columns)
    body = b""
    for row in rows:
        for (_, k), v in zip(columns, row):
            if k == 11:
                body += struct.pack(">II", len(data), len(v))
                data += v
            else:
                body += text(v) if k == 10 else struct.pack({4: ">I", 6: ">Q"}[k], v)
    rows_at = 24 + len(heads)
    size = sum({4: 4, 6: 8, 10: 4, 11: 8}[k] for _, k in columns)
    table = struct.pack(">IIIIHHI", rows_at, rows_at + len(body), rows_at + len(body) + len(strings), 0, len(columns), size, len(rows)) + heads + body + strings + data
    return b"@UTF" + struct.pack(">I", len(table)) + table


def chunk(tag, table):
    return tag + struct.pack("<IQ", 0xFF, len(table)) + table


def test_archives_by_hand(spark):
    """Bytes laid out here, not by this library's writers."""
    # one literal 'c', 'b', 'a' and a pair of distance 3 (a field of 0), length 3 + 1: written from the end on
    bits = "".join("0" + f"{x:08b}" for x in b"cba") + "1" + f"{0:013b}" + "01"
    bits += "0" * (-len(bits) % 8)
    packed = int(bits, 2).to_bytes(len(bits) // 8, "big")[::-1]
    layla = b"CRILAYLA" + struct.pack("<II", 7, len(packed)) + packed + b"HEAD"
    toc = chunk(b"TOC ", utf([("DirName", 10), ("FileName", 10), ("FileSize", 4), ("ExtractSize", 4), ("FileOffset", 6), ("ID", 4)], [("d", "x.bin", 5, 5, 0x400, 1), ("", "y.bin", len(layla), 11, 0x410, 0)]))
    cpk = chunk(b"CPK ", utf([("ContentOffset", 6), ("TocOffset", 6)], [(0x800, 0x400)])).ljust(0x400, b"\0") + toc
    cpk = cpk.ljust(0x800, b"\0") + b"plain".ljust(16, b"\0") + layla
    low = utf([("ID", 4), ("FileSize", 4), ("ExtractSize", 4)], [(0, 3, 3), (2, 4, 4)])
    high = utf([("ID", 4), ("FileSize", 4), ("ExtractSize", 4)], [(1, 5, 5)])
    numbered = chunk(b"CPK ", utf([("ContentOffset", 6), ("ItocOffset", 6), ("Align", 4)], [(0x800, 0x300, 8)])).ljust(0x300, b"\0")
    numbered = (numbered + chunk(b"ITOC", utf([("DataL", 11), ("DataH", 11)], [(low, high)]))).ljust(0x800, b"\0") + b"one".ljust(8, b"\0") + b"three".ljust(8, b"\0") + b"four"
    names = b"a.txt\0b.txt\0"
    at = 0x1C + 8 * 3
    majiro = b"MajiroArcV1.000\0" + struct.pack("<III", 2, at, at + len(names)) + struct.pack("<IIIIII", 7, at + len(names), 8, at + len(names) + 3, 0, at + len(names) + 7) + names + b"abcdefg"
    wide = b"MajiroArcV3.000\0" + struct.pack("<III", 1, 0x1C + 16, 0x1C + 22) + struct.pack("<QII", 7, 0x1C + 22, 4) + b"c.txt\0" + b"data"
    key = bytes.fromhex("c8bb8fb7ed43994aa27e5bb06818f888")
    secret = bytes(range(100))
    hidden = b"AFF\0" + bytes(12) + bytes(x ^ key[i % 16] for i, x in enumerate(secret[:64])) + secret[64:]
    index = struct.pack("<II", 5, 8) + b"q.qnt\0\0\0" + struct.pack("<IIII", 0, 0, 0, len(hidden)) + struct.pack("<II", 1, 4) + b"r\0\0\0" + struct.pack("<IIII", 0, 0, len(hidden), 3)
    packed_index = zlib.compress(index)
    afa = b"AFAH" + struct.pack("<I", 0x1C) + b"AlicArch" + struct.pack("<IIII", 2, 1, 0, 0)[:8]
    afa += struct.pack("<I", 0x2C + len(packed_index)) + b"INFO" + struct.pack("<III", len(packed_index), len(index), 2) + packed_index + hidden + b"raw"
    bgi = b"PackFile    " + struct.pack("<I", 1) + b"n.txt".ljust(16, b"\0") + struct.pack("<II", 0, 4) + bytes(8) + b"text"
    cases = {"CPK": (cpk, {"d/x.bin": b"plain", "y.bin": b"HEAD" + b"cbacbac"[::-1]}), "CPK2": (numbered, {"00000": b"one", "00001": b"three", "00002": b"four"})}
    cases |= {"MAJIRO": (majiro, {"a.txt": b"abc", "b.txt": b"defg"}), "MAJIRO3": (wide, {"c.txt": b"data"}), "AFA": (afa, {"q.qnt": secret, "r": b"raw"}), "ARC/BGI": (bgi, {"n.txt": b"text"})}
    f = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "path string, content binary")
    listed = cs.list_members(f)
    got = {}
    for r in cs.open_members(listed, f).collect():
        got.setdefault(r["path"], {})[r["name"]] = r["data"] and bytes(r["data"])
    for k, (_, want) in cases.items():
        assert got.get(k) == want, (k, got.get(k), [r["error"] for r in listed.collect() if r["path"] == k])


def test_files_deleted_and_renamed(spark, tmp_path):
    for n in ("a", "b", "c", "d"):
        (tmp_path / n).write_text(n)
    (tmp_path / "folder").mkdir()
    at = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([(at("a"),), (at("none"),), (at("folder"),), (None,)], "path string")
    got = {r["path"]: r["status"] for r in sink.delete_files(df).collect()}
    assert got[at("a")] == "deleted" and got[at("none")] == "missing" and got[at("folder")].startswith("error") and got[None].startswith("error")
    df = spark.createDataFrame([(at("b"), "x"), (at("c"), "d"), (at("d"), "d"), (at("c"), "../e"), (at("gone"), "x2")], "path string, name string")
    got = [r["status"].split(":")[0] for r in sink.rename_files(df.coalesce(1)).collect()]
    assert got == ["renamed", "error", "same", "error", "error"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c", "d", "folder", "x"]


def test_history_of_visits(spark):
    import random

    from holdfast.operators import layout

    r, events, want = random.Random(2), [], {}
    for user in range(3):
        back, ahead, now, seen = [], [], None, False
        for i in range(60):
            act = r.choice(["visit", "visit", "undo", "redo"])
            events.append((user, i, act, f"s{i}"))
            if act == "visit":
                back, ahead, now, seen = (back + [now] if seen else back)[-5:], [], f"s{i}", True
            elif act == "undo" and back:
                ahead, now, back = [*ahead, now], back[-1], back[:-1]
            elif act == "redo" and ahead:
                back, now, ahead = [*back, now], ahead[-1], ahead[:-1]
            want[user, i] = (act, now, len(back), len(ahead))
    df = spark.createDataFrame(r.sample(events, len(events)), "u int, i int, act string, s string")
    got = {(x["u"], x["step"]): (x["action"], x["now"], x["n_back"], x["n_ahead"]) for x in layout.history(df, ["u"], ["i"], "act", "s", 5).collect()}
    assert got == want


def test_command_line(spark, tmp_path, capsys):
    from holdfast.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(sink.build_zip([("x.txt", b"text"), ("y/z.txt", b"more")]))
    assert main(["list", str(tmp_path / "in")]) == 0
    out = capsys.readouterr().out.splitlines()
    assert [line.split()[1:] for line in out] == [["6", "x.txt"], ["6", "y/z.txt"]]
    assert main(["extract", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert capsys.readouterr().out == "written: 2\n"
    assert (tmp_path / "out" / "y" / "z.txt").read_bytes() == b"more"
    assert main(["formats"]) == 0 and " ZIP " in capsys.readouterr().out


def test_plug_ins_are_found(tmp_path, monkeypatch):
    from holdfast import catalog

    (tmp_path / "extra_format.py").write_text("from holdfast import catalog\ncatalog.register(catalog.Format('EXTRA', 'archive', 'From a plug-in', [1], ['extra']))\n")
    info = tmp_path / "extra-1.0.dist-info"
    info.mkdir()
    (info / "METADATA").write_text("Metadata-Version: 2.1\nName: extra\nVersion: 1.0\n")
    (info / "entry_points.txt").write_text("[holdfast.formats]\nextra = extra_format\nbroken = no_such_module\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(catalog, "_REGISTRY", dict(catalog._REGISTRY))
    failed = catalog.discover()
    assert "EXTRA" in catalog._REGISTRY and len(failed) == 1 and failed[0].startswith("broken")
