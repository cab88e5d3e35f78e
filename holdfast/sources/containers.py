"""Containers to member rows.

Most layouts are one template: a magic, a count, fixed records of name, offset
and size. They are data (Layout), read by one interpreter; code is written only
for packed, segmented or typed indexes. Listing happens in an Arrow batch
function over (path, content); a file that is not in the layout gives one row
with an error and no member, and never fails the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import bytesfn, codecs
from holdfast.operators.layout import MAX_MEMBERS

ENTRY = "path string, tag string, ord int, name string, offset bigint, size bigint, unpacked_size bigint, is_packed boolean, packing string, segments array<struct<is_packed: boolean, offset: bigint, size: bigint, packed_size: bigint>>, attrs map<string, string>, error string"
READERS: dict[str, Callable[[bytes], Iterator[dict]]] = {}


@dataclass(frozen=True)
class Layout:
    """A container of fixed records.

    name, offset, size, unpacked: (place in the record, width); width of a name
    is its field, cut at NUL. count: (place in the file, width). records: where
    they begin, or (place, width) of a field that says so. base: what offsets
    count from; 'end' is the end of the records. size None: to the next offset.
    key: bytes that records are combined with by exclusive or.
    """

    tag: str
    magic: bytes = b""
    count: tuple[int, int] = (4, 4)
    records: int | tuple[int, int] = 8
    record: int = 32
    name: tuple[int, int] = (0, 24)
    offset: tuple[int, int] | None = (24, 4)
    size: tuple[int, int] | None = (28, 4)
    unpacked: tuple[int, int] | None = None
    base: int | str | tuple[int, int] = 0
    order: str = "little"
    charset: str = "cp932"
    packing: str | None = None
    key: bytes | None = None

    def _int(self, b: bytes, at: tuple[int, int]) -> int:
        part = b[at[0] : at[0] + at[1]]
        if len(part) < at[1]:
            raise ValueError("truncated")
        return int.from_bytes(part, self.order)

    def list(self, b: bytes) -> Iterator[dict]:
        if not b.startswith(self.magic):
            raise ValueError("not this format")
        n = self._int(b, self.count)
        if not 0 < n < MAX_MEMBERS:
            raise ValueError(f"no sane count: {n}")
        first = self.records if isinstance(self.records, int) else self._int(b, self.records)
        end = first + n * self.record
        if end > len(b):
            raise ValueError("index beyond the end")
        base = end if self.base == "end" else self._int(b, self.base) if isinstance(self.base, tuple) else self.base
        run = base
        rows = []
        for i in range(n):
            r = b[first + i * self.record : first + (i + 1) * self.record]
            r = bytes(codecs._xor(r, self.key)) if self.key else r
            name = r[self.name[0] : self.name[0] + self.name[1]].split(b"\0", 1)[0].decode(self.charset, "replace")
            if not name.strip():
                raise ValueError("a member without a name")
            size = self._int(r, self.size) if self.size else None
            at = base + self._int(r, self.offset) if self.offset else run
            run += size or 0
            rows.append({"name": name, "offset": at, "size": size, "unpacked_size": self._int(r, self.unpacked) if self.unpacked else None})
        if not self.size:
            for r, nxt in zip(rows, [*rows[1:], {"offset": len(b)}]):
                r["size"] = nxt["offset"] - r["offset"]
        for r in rows:
            r["is_packed"] = r["unpacked_size"] is not None and r["unpacked_size"] != r["size"]
            r["packing"] = self.packing if r["is_packed"] else None
            if not (0 <= r["offset"] < len(b) and 0 <= r["size"] <= len(b) - r["offset"]):
                raise ValueError("a member beyond the end")
            if not self.magic and r["offset"] < end:
                raise ValueError("a member inside the index")
        yield from rows


def reader(tag):
    return lambda f: READERS.setdefault(tag, f)


@reader("ZIP")
def list_zip(b: bytes) -> Iterator[dict]:
    """Central directory of a ZIP file, with the 64-bit end record and sizes where 32 bits do not hold them."""
    end = b.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end record")
    n, _, at = struct.unpack_from("<HII", b, end + 10)
    if (n == 0xFFFF or at == 0xFFFFFFFF) and b[end - 20 : end - 16] == b"PK\6\7":
        wide = struct.unpack_from("<Q", b, end - 12)[0]
        if b[wide : wide + 4] != b"PK\6\6":
            raise ValueError("bad 64-bit end record")
        n, _, at = struct.unpack_from("<QQQ", b, wide + 32)
    for _ in range(n):
        if b[at : at + 4] != b"PK\1\2":
            raise ValueError("bad directory")
        flags, method, _, _, crc, packed, size, ln, lx, lc = struct.unpack_from("<HHHHIIIHHH", b, at + 8)
        head = struct.unpack_from("<I", b, at + 42)[0]
        name = b[at + 46 : at + 46 + ln].decode("utf-8" if flags & 0x800 else "cp932", "replace")
        size, packed, head = _wide_sizes(b[at + 46 + ln : at + 46 + ln + lx], size, packed, head)
        data = head + 30 + sum(struct.unpack_from("<HH", b, head + 26))
        packing = "encrypted" if flags & 1 else {0: None, 8: "deflate", 12: "bz2", 14: "zip_lzma", 93: "zstd"}.get(method, f"method{method}")
        if not name.endswith("/"):
            yield {"name": name, "offset": data, "size": packed, "unpacked_size": size, "is_packed": method != 0, "packing": packing, "attrs": {"crc32": str(crc), "encrypted": str(bool(flags & 1)).lower()}}
        at += 46 + ln + lx + lc


def _wide_sizes(extra: bytes, *fields: int) -> list[int]:
    """Fields of 32 bits that are all ones stand in the extra field 1, in their order."""
    i, values = 0, b""
    while i + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, i)
        if tag == 1:
            values = extra[i + 4 : i + 4 + n]
        i += 4 + n
    out, at = [], 0
    for x in fields:
        if x == 0xFFFFFFFF and at + 8 <= len(values):
            x, at = struct.unpack_from("<Q", values, at)[0], at + 8
        out.append(x)
    return out


#: fixed values of the format: the head of a segmented archive
XP3_MAGIC = b"XP3\r\n \n\x1a\x8bg\x01"


@reader("XP3")
def list_xp3(b: bytes) -> Iterator[dict]:
    """A packed index of chunks: File holds info (sizes, name), segm (segments), adlr (checksum)."""
    if not b.startswith(XP3_MAGIC):
        raise ValueError("not this format")
    at = struct.unpack_from("<Q", b, 11)[0]
    if b[at] & 1:
        packed, size = struct.unpack_from("<QQ", b, at + 1)
        index = zlib.decompress(b[at + 17 : at + 17 + packed])
    else:
        size = struct.unpack_from("<Q", b, at + 1)[0]
        index = b[at + 9 : at + 9 + size]

    def chunks(x):
        i = 0
        while i + 12 <= len(x):
            n = struct.unpack_from("<Q", x, i + 4)[0]
            yield x[i : i + 4], x[i + 12 : i + 12 + n]
            i += 12 + n

    for kind, body in chunks(index):
        if kind != b"File":
            continue
        part = dict(chunks(body))
        flags, size, packed, ln = struct.unpack_from("<IQQH", part[b"info"], 0)
        segs = []
        for i in range(0, len(part[b"segm"]) - 27, 28):
            f, off, s, p = struct.unpack_from("<IQQQ", part[b"segm"], i)
            segs.append({"is_packed": bool(f & 7), "offset": off, "size": s, "packed_size": p})
        yield {"name": part[b"info"][22 : 22 + 2 * ln].decode("utf-16le"), "offset": segs[0]["offset"] if segs else -1, "size": packed, "unpacked_size": size, "is_packed": any(s["is_packed"] for s in segs), "packing": "segments", "segments": segs, "attrs": {"encrypted": str(bool(flags)).lower(), "adler32": str(struct.unpack("<I", part[b"adlr"][:4])[0]) if b"adlr" in part else ""}}


def _big_endian(b: bytes, with_packing: bool) -> Iterator[dict]:
    n, base = struct.unpack_from(">HI", b, 0)
    if not n or base > len(b) or base < 6:
        raise ValueError("not this format")
    i = 6
    for _ in range(n):
        j = b.index(b"\0", i)
        name, i = b[i:j].decode("cp932", "replace"), j + 1
        kind = b[i] if with_packing else 0
        i += with_packing
        off, size = struct.unpack_from(">II", b, i)
        i += 8
        full = size
        if with_packing:
            full = struct.unpack_from(">I", b, i)[0]
            i += 4
        if base + off + size > len(b):
            raise ValueError("a member beyond the end")
        yield {"name": name, "offset": base + off, "size": size, "unpacked_size": full, "is_packed": kind != 0, "packing": {0: None, 1: "spb", 2: "lzss", 4: "nbz"}.get(kind, f"kind{kind}")}


READERS["SAR"] = lambda b: _big_endian(b, False)
READERS["NSA"] = lambda b: _big_endian(b, True)


@reader("WILL")
def list_will(b: bytes) -> Iterator[dict]:
    """Directories by extension: ext[4], count, place of its records name[9], size, offset."""
    n = struct.unpack_from("<I", b, 0)[0]
    if not 0 < n < 256:
        raise ValueError("not this format")
    for i in range(n):
        ext, count, at = struct.unpack_from("<4sII", b, 4 + 12 * i)
        for k in range(count):
            name, size, off = struct.unpack_from("<9sII", b, at + 17 * k)
            if off + size > len(b):
                raise ValueError("a member beyond the end")
            yield {"name": name.split(b"\0")[0].decode("cp932", "replace") + "." + ext.split(b"\0")[0].decode("ascii").lower(), "offset": off, "size": size, "unpacked_size": size, "is_packed": False}


def read_pickle(b: bytes):
    """Dicts, lists, tuples, numbers and strings of a pickle; nothing is ever called or imported."""
    import io
    import pickle

    class Plain(pickle.Unpickler):
        def find_class(self, module, name):
            if (module, name) in (("_codecs", "encode"), ("codecs", "encode")):
                return lambda s, charset="latin1": s.encode("latin1")
            raise ValueError(f"not plain data: {module}.{name}")

    return Plain(io.BytesIO(b), encoding="latin1").load()


@reader("RPA")
def list_rpa(b: bytes) -> Iterator[dict]:
    """A line with the place of a packed index (and a number that it is combined with): name -> [(offset, size[, head])]."""
    line = b.split(b"\n", 1)[0].split()
    if not line or line[0] not in (b"RPA-2.0", b"RPA-3.0"):
        raise ValueError("not this format")
    key = 0
    for part in line[2:]:
        key ^= int(part, 16)
    for name, parts in read_pickle(zlib.decompress(b[int(line[1], 16) :])).items():
        off, size, *head = parts[0]
        off, size = off ^ key, size ^ key
        head = (head[0] if head else b"") or b""
        head = head.encode("latin1") if isinstance(head, str) else head
        if off + size > len(b):
            raise ValueError("a member beyond the end")
        yield {"name": name if isinstance(name, str) else name.decode("utf-8"), "offset": off, "size": size, "unpacked_size": size + len(head), "is_packed": False, "attrs": {"head": head.hex()}}


#: Layouts that are data only, in the usual shape.
LAYOUTS = {
    "GENERIC/PACK": Layout("GENERIC/PACK", b"PACK", (4, 4), 8, 40, (0, 32), (32, 4), (36, 4)),
    "GENERIC/REL": Layout("GENERIC/REL", b"PackFile", (8, 4), 12, 32, (0, 16), (16, 4), (20, 4), None, "end"),
    "GENERIC/LEAD": Layout("GENERIC/LEAD", b"LEAD", (4, 4), 8, 20, (0, 16), (16, 4), None),
    "GENERIC/LZSS": Layout("GENERIC/LZSS", b"LZPK", (4, 4), 8, 44, (0, 32), (32, 4), (36, 4), (40, 4), packing="lzss"),
}
READERS.update({k: v.list for k, v in LAYOUTS.items()})


def list_members(files: DataFrame, candidates: list[str] | None = None, readers: dict | None = None) -> DataFrame:
    """Rows of ENTRY for files (path, content[, tags: candidates in order]).

    The first reader that lists a file wins; if none does, one row carries the
    reasons.
    """
    known = dict(readers if readers is not None else READERS)
    order = list(candidates if candidates is not None else known)
    has_tags = "tags" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                why = []
                for tag in r["tags"] if has_tags and r["tags"] is not None else order:
                    if tag not in known:
                        continue
                    try:
                        got = [e | {"path": r["path"], "tag": tag, "ord": i} for i, e in enumerate(known[tag](r["content"] or b""))]
                    except Exception as e:  # noqa: BLE001  not in this layout
                        why.append(f"{tag}: {e}")
                        continue
                    rows += got
                    break
                else:
                    rows.append({"path": r["path"], "error": "; ".join(why) or "no candidate"})
            yield pa.RecordBatch.from_pylist([{**e, "attrs": list((e.get("attrs") or {}).items())} for e in rows], schema=_ARROW)

    cols = ["path", "content", "tags"] if has_tags else ["path", "content"]
    return files.select(*cols).mapInArrow(run, ENTRY)


_ARROW = pa.schema(
    [("path", pa.string()), ("tag", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("unpacked_size", pa.int64()), ("is_packed", pa.bool_()), ("packing", pa.string()), ("segments", pa.list_(pa.struct([("is_packed", pa.bool_()), ("offset", pa.int64()), ("size", pa.int64()), ("packed_size", pa.int64())]))), ("attrs", pa.map_(pa.string(), pa.string())), ("error", pa.string())]
)


#: Packings that a decoder of the same name opens.
PACKINGS = ("deflate", "zlib", "lzss", "lzma", "zip_lzma", "bz2", "zstd", "nbz", "spb", "layla", "aff")


def _segments(content: pa.Scalar, segs: pa.Scalar) -> bytes:
    view, out = content.as_buffer(), []
    for s in segs.as_py():
        piece = view[s["offset"] : s["offset"] + (s["packed_size"] if s["is_packed"] else s["size"])]
        piece = zlib.decompress(piece) if s["is_packed"] else piece
        if len(piece) != s["size"]:
            raise ValueError("a segment of another size")
        out.append(piece)
    return b"".join(out)


def _unpacked(packing: pa.Array, raw: pa.Array, content: pa.Array, segs: pa.Array) -> pa.Array:
    data, errors = [], []
    for name, r, c, s in zip(packing.to_pylist(), raw, content, segs):
        got, why = None, None
        try:
            if name == "segments":
                got = _segments(c, s) if c.is_valid else None
            elif name not in PACKINGS:
                why = f"no decoder for {name}"
            elif r.is_valid:
                got = bytes(codecs.DECODERS[name](r.as_py()))
        except Exception as e:  # noqa: BLE001  reported with its row
            why = f"{type(e).__name__}: {e}"
        data.append(got)
        errors.append(why)
    return pa.StructArray.from_arrays([pa.array(data, pa.binary()), pa.array(errors, pa.string())], ["data", "error"])


def open_members(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries with data, the member's bytes, unpacked: a row for every member.

    Plain members are slices (no Python); packed ones are a branch of their
    own. What cannot be opened has null data and the reason in error: a packing
    without a decoder, a bad stream, a place beyond the end.
    """
    e = entries.filter(F.col("name").isNotNull()).join(files.select("path", "content"), "path", "left")
    head = F.coalesce(F.unhex(F.try_element_at("attrs", F.lit("head"))), F.lit(b""))
    cut = bytesfn.member(F.col("content"), F.col("offset"), F.col("size"))
    raw = F.when(F.octet_length(cut) == F.col("size"), F.concat(head, cut))
    plain = e.filter("packing IS NULL").withColumn("o_", F.struct(raw.alias("data"), F.lit(None).cast("string").alias("error")))
    unpack = F.arrow_udf(_unpacked, "struct<data: binary, error: string>")
    packed = e.filter("packing IS NOT NULL").withColumn("o_", unpack(F.col("packing"), F.when(F.col("packing") != "segments", raw), F.when(F.col("packing") == "segments", F.col("content")), F.col("segments")))
    why = F.when(F.col("o_.data").isNull(), F.coalesce("o_.error", F.when(F.col("content").isNull(), "no content").otherwise("beyond the end")))
    return plain.unionByName(packed).withColumn("error", F.coalesce("error", why)).withColumn("data", F.col("o_.data")).drop("content", "o_")


def expand(files: DataFrame, depth: int = 2, readers: dict | None = None) -> DataFrame:
    """Members of containers, and of containers inside them, to `depth`: container_path (array), name, data."""
    level = files.select("path", "content").withColumn("container_path", F.array("path"))
    out = None
    for _ in range(depth):
        listed = list_members(level.select(F.to_json("container_path").alias("path"), "content"), readers=readers).filter("error IS NULL")
        opened = open_members(listed, level.select(F.to_json("container_path").alias("path"), "content"))
        got = opened.filter("data IS NOT NULL").select(F.from_json("path", "array<string>").alias("container_path"), "tag", "ord", "name", "data")
        out = got if out is None else out.unionByName(got)
        level = got.select("name", F.col("data").alias("content"), F.concat("container_path", F.array("name")).alias("container_path")).withColumnRenamed("name", "path")
    return out


def split_parts(entries: DataFrame, parts: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Members of a container in several files: name, data from slices of parts (part_no, start, end, content)."""
    from holdfast.operators import layout

    e = entries.withColumn("stop", F.col("offset") + F.col("size")).withColumn("k", F.lit(0))
    met = layout.overlap_join(e, parts.withColumn("k", F.lit(0)), ["k"], ("offset", "stop"), ("start", "end"), width)
    low, high = F.greatest("offset", "start"), F.least("stop", "end")
    cut = met.withColumn("piece", F.substring("content", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")))
    glue = F.aggregate(F.array_sort(F.collect_list(F.struct("part_no", "piece"))), F.lit(b""), lambda a, x: F.concat(a, x.piece))
    return cut.groupBy("name", "offset", "size").agg(glue.alias("data"))


# typed tables (@UTF)

_WIDTHS = {0: ("B", "int"), 1: ("b", "int"), 2: (">H", "int"), 3: (">h", "int"), 4: (">I", "int"), 5: (">i", "int"), 6: (">Q", "int"), 7: (">q", "int"), 8: (">f", "float")}


def read_utf(b: bytes) -> list[dict]:
    """Rows of an @UTF table; columns that are constant or without storage are skipped."""
    if b[:4] != b"@UTF":
        raise ValueError("not a table")
    t = b[8:]
    rows_at, strings, data, _, columns, row_size, n = struct.unpack_from(">IIIIHHI", t, 0)
    text = lambda at: t[strings + at : t.index(b"\0", strings + at)].decode("utf-8", "replace")
    cols, i = [], 24
    for _ in range(columns):
        flags = t[i]
        name = text(struct.unpack_from(">I", t, i + 1)[0])
        i += 5
        kind, storage = flags & 0xF, flags & 0xF0
        if storage == 0x30:
            i += {10: 4, 11: 8}.get(kind) or struct.calcsize(_WIDTHS[kind][0])
        cols.append((name, kind, storage))
    out = []
    for r in range(n):
        at, row = rows_at + r * row_size, {}
        for name, kind, storage in cols:
            if storage != 0x50:
                continue
            if kind == 10:
                row[name] = text(struct.unpack_from(">I", t, at)[0])
                at += 4
            elif kind == 11:
                off, size = struct.unpack_from(">II", t, at)
                row[name] = t[data + off : data + off + size]
                at += 8
            elif kind in _WIDTHS:
                row[name] = struct.unpack_from(_WIDTHS[kind][0], t, at)[0]
                at += struct.calcsize(_WIDTHS[kind][0])
            else:
                raise ValueError(f"column type {kind}")
        out.append(row)
    return out


@reader("CPK")
def list_cpk(b: bytes) -> Iterator[dict]:
    """Members named in a TOC table, or numbered in an ITOC table of two: the smaller sizes, the larger ones."""
    if b[:4] != b"CPK ":
        raise ValueError("not this format")
    head = read_utf(b[16 : 16 + struct.unpack_from("<Q", b, 8)[0]])[0]
    found: dict[int, dict] = {}
    if head.get("TocOffset"):
        toc = head["TocOffset"]
        if b[toc : toc + 4] != b"TOC ":
            raise ValueError("no table of contents")
        base = min(head["ContentOffset"], toc)
        for row in read_utf(b[toc + 16 : toc + 16 + struct.unpack_from("<Q", b, toc + 8)[0]]):
            name = "/".join(x for x in (row.get("DirName"), row["FileName"]) if x)
            found[row["ID"]] = {"name": name, "offset": base + row["FileOffset"], "size": row["FileSize"], "unpacked_size": row.get("ExtractSize", row["FileSize"])}
    if head.get("ItocOffset") and not found:
        at, align = head["ItocOffset"], head.get("Align") or 1
        if b[at : at + 4] != b"ITOC":
            raise ValueError("no numbered table")
        row = read_utf(b[at + 16 : at + 16 + struct.unpack_from("<Q", b, at + 8)[0]])[0]
        rows = [r for k in ("DataL", "DataH") if row.get(k) for r in read_utf(row[k])]
        place = head["ContentOffset"]
        for r in sorted(rows, key=lambda r: r["ID"]):
            found[r["ID"]] = {"name": f"{r['ID']:05d}", "offset": place, "size": r["FileSize"], "unpacked_size": r.get("ExtractSize", r["FileSize"])}
            place += -(-r["FileSize"] // align) * align
    for _, e in sorted(found.items()):
        if not 0 <= e["offset"] <= e["offset"] + e["size"] <= len(b):
            raise ValueError("a member beyond the end")
        layla = b[e["offset"] : e["offset"] + 8] == b"CRILAYLA"
        yield e | {"is_packed": layla, "packing": "layla" if layla else None}


@reader("MAJIRO")
def list_majiro(b: bytes) -> Iterator[dict]:
    """Names in their own block, NUL after each; records of hash, offset and (from version 2) size; version 3 has wide hashes."""
    if b[:10] != b"MajiroArcV" or b[11:16] != b".000\0" or not 1 <= b[10] - 48 <= 3:
        raise ValueError("not this format")
    version = b[10] - 48
    n, names, data = struct.unpack_from("<III", b, 16)
    record, width = 4 * (version + 1), 8 if version == 3 else 4
    if not 0 < n < MAX_MEMBERS or 0x1C + record * (n + (version == 1)) != names or not names < data <= len(b):
        raise ValueError("no sane index")
    for i, name in enumerate(b[names:data].split(b"\0")[:n]):
        at = 0x1C + record * i + width
        offset = struct.unpack_from("<I", b, at)[0]
        size = max(0, struct.unpack_from("<I", b, at + record)[0] - offset) if version == 1 else struct.unpack_from("<I", b, at + 4)[0]
        if not data <= offset <= offset + size <= len(b):
            raise ValueError("a member beyond the end")
        yield {"name": name.decode("cp932", "replace"), "offset": offset, "size": size, "is_packed": False, "packing": None}


@reader("AFA")
def list_afa(b: bytes) -> Iterator[dict]:
    """A deflated index: for each member the name in a padded field, two or three numbers, offset and size."""
    if b[:4] != b"AFAH" or b[8:16] != b"AlicArch" or b[0x1C:0x20] != b"INFO":
        raise ValueError("not this format")
    version, base, packed, _, n = struct.unpack_from("<I4xIxxxxIII", b, 0x10)
    if not 0 < n < MAX_MEMBERS:
        raise ValueError(f"no sane count: {n}")
    index, at = zlib.decompress(b[0x2C : 0x2C + packed]), 0
    for _ in range(n):
        used, field = struct.unpack_from("<II", index, at)
        name = index[at + 8 : at + 8 + used].decode("cp932", "replace")
        at += 8 + field + (12 if version < 2 else 8)
        offset, size = struct.unpack_from("<II", index, at)
        at += 8
        if not 0 < used <= field or base + offset + size > len(b):
            raise ValueError("a member beyond the end")
        hidden = size > 0x10 and b[base + offset : base + offset + 4] == b"AFF\0"
        yield {"name": name, "offset": base + offset, "size": size, "is_packed": hidden, "packing": "aff" if hidden else None}


def utf_rows(tables: DataFrame, content: str = "content") -> DataFrame:
    """key, row_no, row (map of column name to text) of each table."""

    @F.udf("array<map<string, string>>", useArrow=True)
    def rows(b):
        try:
            return [{k: v.hex() if isinstance(v, bytes) else str(v) for k, v in r.items()} for r in read_utf(bytes(b))]
        except Exception:  # noqa: BLE001
            return None

    return tables.select("path", F.posexplode(rows(content)).alias("row_no", "row"))


def exe_find(content: Column, section: str, what: bytes) -> Column:
    """Offset in the file of the first occurrence of `what` inside a section of a PE file, -1 if there is none."""
    hit = F.get(F.filter(exe_sections(content), lambda x: x["name"] == section), F.lit(0))
    body = bytesfn.slice_of(content, hit["offset"], hit["size"])
    at = bytesfn.find_bytes(body, what)
    return F.when(hit.isNotNull() & (at >= 0), at + hit["offset"]).otherwise(F.lit(-1).cast("bigint"))


def exe_resources(content: Column) -> Column:
    """array of resources of a PE file: type, name, place and size in the file (numbers as #n)."""

    @F.udf("array<struct<type: string, name: string, offset: bigint, size: bigint>>", useArrow=True)
    def run(b):
        try:
            return pe_resources(bytes(b or b""))
        except (struct.error, ValueError, IndexError):
            return None

    return run(content)


def pe_resources(b: bytes) -> list[tuple] | None:
    u = struct.unpack_from
    pe = u("<I", b, 60)[0]
    if b[:2] != b"MZ" or b[pe : pe + 4] != b"PE\0\0":
        return None
    n, opt = u("<H", b, pe + 6)[0], u("<H", b, pe + 20)[0]
    plus = u("<H", b, pe + 24)[0] == 0x20B
    root_va = u("<I", b, pe + 24 + (112 if plus else 96) + 16)[0]
    secs = [u("<8sIIII", b, pe + 24 + opt + 40 * i) for i in range(n)]

    def place(va):
        for _, vs, at, size, off in secs:
            if at <= va < at + max(vs, size):
                return va - at + off
        raise ValueError("no section")

    if not root_va:
        return []
    base = place(root_va)

    def label(v):
        if v >> 31:
            at = base + (v & 0x7FFFFFFF)
            return b[at + 2 : at + 2 + 2 * u("<H", b, at)[0]].decode("utf-16le")
        return f"#{v}"

    def entries(at):
        named, ids = u("<HH", b, at + 12)
        return [u("<II", b, at + 16 + 8 * i) for i in range(named + ids)]

    out = []
    for kind, sub in entries(base):
        for name, leaf in entries(base + (sub & 0x7FFFFFFF)):
            for _, data in entries(base + (leaf & 0x7FFFFFFF)):
                va, size = u("<II", b, base + data)
                out.append((label(kind), label(name), place(va), size))
    return out


def exe_sections(content: Column) -> Column:
    """array of sections of a PE file: name, virtual address and size, place and size in the file."""

    @F.udf("array<struct<name: string, va: bigint, vsize: bigint, offset: bigint, size: bigint>>", useArrow=True)
    def run(b):
        b = bytes(b or b"")
        if b[:2] != b"MZ" or len(b) < 64:
            return None
        pe = struct.unpack_from("<I", b, 60)[0]
        if b[pe : pe + 4] != b"PE\0\0":
            return None
        n, opt = struct.unpack_from("<H", b, pe + 6)[0], struct.unpack_from("<H", b, pe + 20)[0]
        out = []
        for i in range(n):
            name, vs, va, size, off = struct.unpack_from("<8sIIII", b, pe + 24 + opt + 40 * i)
            out.append((name.rstrip(b"\0").decode("ascii", "replace"), va, vs, off, size))
        return out

    return run(content)
