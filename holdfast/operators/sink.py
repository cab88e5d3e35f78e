"""Sinks: extract members to files, build containers, convert media.

A container is one value (fewer than 0x40000 members, under 2 GiB), so building
one is a grouped function over its own members; different containers are built
in parallel. Names are checked and duplicates dropped before the sink, as
columns, so the sink itself has nothing to decide.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.functions import codecs, media, text
from holdfast.operators import paths
from holdfast.sources.containers import XP3_MAGIC, Layout

POLICIES = ("skip", "overwrite", "rename", "error")


def checked(entries: DataFrame, key: str = "archive", name_col: str = "name", ord_col: str = "ord", charset: str = "cp932") -> DataFrame:
    """entries with problem: null, or why a writer must leave the row out (empty name, charset, duplicate, size)."""
    coded = text.encode_strict(F.col(name_col), charset)
    w = Window.partitionBy(key, F.lower(name_col)).orderBy(ord_col)
    return entries.withColumn("coded_", coded).withColumn("rn_", F.row_number().over(w)).withColumn(
        "problem",
        F.when(~paths.is_valid_name(F.col(name_col)), "name").when(F.col("coded_").isNull(), "charset").when(F.col("rn_") > 1, "duplicate").when(F.octet_length("data") > 0xFFFFFFFF, "size"),
    ).drop("coded_", "rn_")


def build_zip(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _big_endian(members, packed: bool) -> bytes:
    bodies = []
    for name, data in members:
        small = bytes(codecs.lzss_encode(data)) if packed else data
        kind = 2 if packed and len(small) < len(data) else 0
        bodies.append((name.encode("cp932") + b"\0", kind, small if kind else data, len(data)))
    extra = 5 if packed else 0
    base, at, index = 6 + sum(len(n) + 8 + extra for n, *_ in bodies), 0, b""
    for name, kind, body, full in bodies:
        index += name + (bytes([kind]) if packed else b"") + struct.pack(">II", at, len(body)) + (struct.pack(">I", full) if packed else b"")
        at += len(body)
    return struct.pack(">HI", len(bodies), base) + index + b"".join(b for _, _, b, _ in bodies)


def build_will(members) -> bytes:
    """Grouped by extension, sorted; names of up to eight characters, extensions of up to three."""
    groups: dict[str, list] = {}
    for name, data in members:
        stem, _, ext = name.rpartition(".")
        if not stem or len(ext) > 3 or len(stem.encode("cp932")) > 8:
            raise ValueError(f"{name} does not fit")
        groups.setdefault(ext.upper(), []).append((stem, data))
    at = 4 + 12 * len(groups)
    data_at = at + 17 * sum(map(len, groups.values()))
    head, records, body = struct.pack("<I", len(groups)), b"", b""
    for ext, own in sorted(groups.items()):
        head += struct.pack("<4sII", ext.encode("ascii"), len(own), at + len(records))
        for stem, data in own:
            records += struct.pack("<9sII", stem.encode("cp932"), len(data), data_at + len(body))
            body += data
    return head + records + body


def build_xp3(members) -> bytes:
    body, index = bytearray(XP3_MAGIC + bytes(8)), b""
    for name, data in members:
        small = zlib.compress(data)
        packed = len(small) < len(data)
        at, kept = len(body), small if packed else data
        body += kept
        coded = name.encode("utf-16le")
        info = struct.pack("<IQQH", 0, len(data), len(kept), len(name)) + coded
        segm = struct.pack("<IQQQ", int(packed), at, len(data), len(kept))
        adlr = struct.pack("<I", zlib.adler32(data))
        part = b"".join(n + struct.pack("<Q", len(x)) + x for n, x in ((b"info", info), (b"segm", segm), (b"adlr", adlr)))
        index += b"File" + struct.pack("<Q", len(part)) + part
    struct.pack_into("<Q", body, len(XP3_MAGIC), len(body))
    small = zlib.compress(index)
    return bytes(body) + b"\x01" + struct.pack("<QQ", len(small), len(index)) + small


def build_rpa(members) -> bytes:
    """Version 3 with number 0: the packed index is a plain pickle behind the data."""
    import pickle

    body, index = bytearray(34), {}
    for name, data in members:
        index[name] = [(len(body), len(data))]
        body += data
    body[:34] = b"RPA-3.0 %016x %08x\n" % (len(body), 0)
    return bytes(body) + zlib.compress(pickle.dumps(index, 2))


def build_layout(layout: Layout) -> Callable[[list[tuple[str, bytes]]], bytes]:
    """A writer for a container that is described as data."""

    def build(members):
        n, e = len(members), layout.order
        said = [f for f in (layout.count, layout.records, layout.base) if isinstance(f, tuple)]
        first = layout.records if isinstance(layout.records, int) else max(len(layout.magic), *[p + w for p, w in said])
        at, index, body = first + n * layout.record, b"", b""
        shift = at if layout.base == "end" or isinstance(layout.base, tuple) else layout.base
        if layout.offset is None and shift != at:
            raise ValueError("members do not follow the records here")
        head = bytearray(layout.magic.ljust(first, b"\0"))
        for field, value in ((layout.count, n), (layout.records, first), (layout.base, at)):
            if isinstance(field, tuple):
                head[field[0] : field[0] + field[1]] = value.to_bytes(field[1], e)
        for name, data in members:
            coded, kept = name.encode(layout.charset), data
            if len(coded) > layout.name[1]:
                raise ValueError(f"{name} does not fit")
            if layout.packing:
                small = bytes(codecs.ENCODERS[layout.packing](data))
                kept = small if len(small) < len(data) else data
            r = bytearray(layout.record)
            r[layout.name[0] : layout.name[0] + len(coded)] = coded
            for place, value in ((layout.offset, at - shift), (layout.size, len(kept)), (layout.unpacked, len(data))):
                if place:
                    r[place[0] : place[0] + place[1]] = value.to_bytes(place[1], e)
            index += codecs._xor(bytes(r), layout.key) if layout.key else bytes(r)
            body += kept
            at += len(kept)
        return bytes(head) + index + body

    return build


WRITERS: dict[str, Callable[[list[tuple[str, bytes]]], bytes]] = {
    "ZIP": build_zip,
    "SAR": lambda m: _big_endian(m, False),
    "NSA": lambda m: _big_endian(m, True),
    "WILL": build_will,
    "XP3": build_xp3,
    "RPA": build_rpa,
}


def build(entries: DataFrame, tag: str, writer: Callable | None = None, sort: str = "ord") -> DataFrame:
    """archive, content, members, error: one container for each value of `archive`.

    entries: archive, ord, name, data. Rows that checked() objects to are left
    out (see its problem column for them).
    """
    make = writer or WRITERS[tag]
    good = checked(entries.select("archive", "ord", "name", "data")).filter("problem IS NULL")

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: r[sort])
        try:
            content, error = make([(r["name"], r["data"] or b"") for r in rows]), None
        except Exception as e:  # noqa: BLE001
            content, error = None, f"{type(e).__name__}: {e}"
        return pa.table({"archive": pa.array([key[0].as_py()]), "content": pa.array([content], pa.binary()), "members": pa.array([len(rows)], pa.int32()), "error": pa.array([error], pa.string())})

    return good.groupBy("archive").applyInArrow(one, "archive string, content binary, members int, error string")


def extract(members: DataFrame, destination: str, on_exists: str = "skip") -> DataFrame:
    """Writes data to destination/name and returns name, target, status of every member ('written', 'skipped', 'overwritten', 'error: ...').

    A member without data is an error, never an empty file.
    destination is a folder that all executors share, as a path or a URI.
    Names are made safe first; with 'rename' duplicates get NAME.1.EXT. A file
    is written beside its place and then moved, so a task that runs twice
    leaves one whole file.
    """
    if on_exists not in POLICIES:
        raise ValueError(on_exists)
    rows = members.withColumn("target", paths.safe_target(F.regexp_replace("name", r"\\", "/")))
    why = F.col("error") if "error" in members.columns else F.lit(None).cast("string")
    rows = rows.withColumn("why", F.when(F.col("data").isNull(), F.concat(F.lit("error: "), F.coalesce(why, F.lit("not decoded")))))
    if on_exists == "rename":
        rows = paths.rename_duplicates(rows.withColumn("name_", F.col("target")).drop("target"), "name_", "ord").drop("name_")
    else:
        # of members with one name the first is written, or the last where later ones replace it
        own = Window.partitionBy(F.lower("target"), F.col("why").isNull())
        turn = F.row_number().over(own.orderBy(F.desc("ord") if on_exists == "overwrite" else F.col("ord")))
        again = {"skip": "skipped", "overwrite": "overwritten", "error": "error: FileExistsError: a member of this name came before"}[on_exists]
        rows = rows.withColumn("why", F.coalesce("why", F.when((turn > 1) & F.col("target").isNotNull(), again)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(destination) if "://" in destination else (fs.LocalFileSystem(), destination)
        for b in batches:
            out = []
            for r in b.to_pylist():
                status = r["why"] or "written"
                try:
                    if r["why"]:
                        out.append({"name": r["name"], "target": r["target"], "status": status})
                        continue
                    if not r["target"]:
                        raise ValueError("no name")
                    place = f"{root}/{r['target']}"
                    there = system.get_file_info(place).type != fs.FileType.NotFound
                    if there and on_exists == "skip":
                        status = "skipped"
                    elif there and on_exists == "error":
                        raise FileExistsError(place)
                    else:
                        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                        side = f"{place}.{uuid.uuid4().hex}.part"
                        with system.open_output_stream(side) as f:
                            f.write(r["data"])
                        system.move(side, place)
                except Exception as e:  # noqa: BLE001  reported with its row
                    status = f"error: {type(e).__name__}: {e}"
                out.append({"name": r["name"], "target": r["target"], "status": status})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("name", pa.string()), ("target", pa.string()), ("status", pa.string())]))

    return rows.select("name", "target", "data", "why").mapInArrow(run, "name string, target string, status string")


def _on_files(rows: DataFrame, columns: list[str], act) -> DataFrame:
    """columns and status of each row, after act(file system, row) on the file in its first column."""
    schema = pa.schema([(c, pa.string()) for c in [*columns, "status"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            out = []
            for r in b.to_pylist():
                try:
                    place = r[columns[0]]
                    system, at = fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)
                    status = act(fs, system, at, r)
                except Exception as e:  # noqa: BLE001  reported with its row
                    status = f"error: {type(e).__name__}: {e}"
                out.append({**r, "status": status})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.select(*columns).mapInArrow(run, ", ".join(f"`{c}` string" for c in [*columns, "status"]))


def delete_files(rows: DataFrame) -> DataFrame:
    """path, status ('deleted', 'missing', 'error: ...') of each file of rows (path); folders stay.

    A task that runs twice finds its files gone: 'missing' is no error.
    """

    def act(fs, system, at, r):
        kind = system.get_file_info(at).type
        if kind == fs.FileType.NotFound:
            return "missing"
        if kind != fs.FileType.File:
            raise IsADirectoryError(at)
        system.delete_file(at)
        return "deleted"

    return _on_files(rows, ["path"], act)


def rename_files(rows: DataFrame) -> DataFrame:
    """path, name, status ('renamed', 'same', 'error: ...') for rows (path, name: the new name in the same folder).

    A name that is there already is an error, and so is one with a folder in it.
    """

    def act(fs, system, at, r):
        name = r["name"]
        if not name or "/" in name or "\\" in name or name in (".", ".."):
            raise ValueError("no file name")
        folder, _, old = at.rpartition("/")
        target = f"{folder}/{name}" if folder else name
        if name == old:
            return "same"
        there, done = (system.get_file_info(x).type != fs.FileType.NotFound for x in (at, target))
        if not there and done:
            return "renamed"  # by an earlier run of the same task
        if done:
            raise FileExistsError(target)
        system.move(at, target)
        return "renamed"

    return _on_files(rows, ["path", "name"], act)


def convert_images(members: DataFrame, to: str, extension: str) -> DataFrame:
    """Images of `members` (name, type, data, ...) in another format under its extension; other rows stay as they are."""
    is_image = F.col("type") == "image"
    done = members.filter(is_image).withColumn("c_", media.convert_image(F.col("data"), to))
    done = done.withColumn("name", F.when(F.col("c_.data").isNotNull(), paths.change_extension(F.col("name"), F.lit(extension))).otherwise(F.col("name")))
    done = done.withColumn("data", F.coalesce("c_.data", "data")).withColumn("error", F.col("c_.error")).drop("c_")
    return done.unionByName(members.filter(~is_image).withColumn("error", F.lit(None).cast("string")))


def convert_audio(members: DataFrame) -> DataFrame:
    """Audio: wave, MP3 and Ogg stay byte for byte under their extension; raw samples with a known header become waves."""
    rows = members.filter("type = 'audio'").withColumn("i_", media.audio_info(F.col("data")))
    kept = F.col("i_.source_format").isin("wav", "mp3", "ogg")
    return rows.withColumn("name", F.when(kept, paths.change_extension(F.col("name"), F.col("i_.source_format"))).otherwise(F.col("name"))).withColumn("ok", kept).drop("i_")
