"""Dimension tables: formats, extension aliases, games, schemes.

They are small (hundreds of rows), so lookups broadcast them; larger ones, read
from a caller's table, are left to the optimizer (see lookup_side).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a dimension is broadcast.
BROADCAST_ROWS = 100_000

FORMATS_SCHEMA = (
    "tag string, description string, type string, signatures array<bigint>, extensions array<string>, "
    "can_write boolean, priority int, is_hierarchic boolean, contained array<string>"
)

#: Order in which kinds of formats are registered.
KINDS = ("image", "archive", "audio", "script")

# fixed values: extension, target tag, type (None: any)
ALIASES = [
    ("ALP", "DAT/GENERIC", None), ("ANM", "TXT", None), ("ASD", "TXT", None), ("BGM", "WAV", None), ("CGR", "PSD", None),
    ("CSF", "DAT/GENERIC", None), ("DOW", "WAV", None), ("GDS", "TXT", None), ("GLT", "BMP", None), ("JCP", "WAV", None),
    ("M", "MP3", "audio"), ("NE", "WAV", None), ("OSA", "BMP", None), ("PSP", "PSB", None), ("SCB", "SCR", None),
    ("SDT", "SCR", None), ("SND", "OGG", None), ("SNR", "SCR", None), ("SPT", "SCR", None), ("STR", "SCR", None),
    ("STR", "TXT", None), ("TBL", "DAT/GENERIC", None), ("TBL", "SCR", None), ("TMX", "DAT/GENERIC", None), ("WF", "WAV", None),
    ("WPN", "TXT", None), ("WPS", "SCR", None), ("_BP", "SCR", None),
]


@dataclass
class Format:
    tag: str
    type: str
    description: str = ""
    signatures: list[int] = field(default_factory=lambda: [0])
    extensions: list[str] | None = None
    can_write: bool = False
    priority: int = 0
    is_hierarchic: bool = False
    contained: list[str] = field(default_factory=list)

    def row(self) -> tuple:
        ext = self.extensions if self.extensions is not None else [self.tag.split("/")[0].lower()]
        return (self.tag, self.description, self.type, self.signatures, ext, self.can_write, self.priority, self.is_hierarchic, self.contained)


def magic(text: bytes) -> int:
    """First four bytes as an unsigned little-endian number."""
    return int.from_bytes(text[:4].ljust(4, b"\0"), "little")


_REGISTRY: dict[str, Format] = {}


def register(*formats: Format) -> None:
    """Adds formats; a plug-in calls this when it is imported."""
    _REGISTRY.update({f.tag: f for f in formats})


def discover(group: str = "holdfast.formats") -> list[str]:
    """Imports the plug-ins that installed packages name under `group` (each registers its formats); those that fail are returned."""
    from importlib.metadata import entry_points

    failed = []
    for point in entry_points(group=group):
        try:
            point.load()
        except Exception as e:  # noqa: BLE001  one bad plug-in must not hide the others
            failed.append(f"{point.name}: {type(e).__name__}: {e}")
    return failed


register(
    Format("PNG", "image", "Portable Network Graphics", [magic(b"\x89PNG")], ["png"], True, 100),
    Format("BMP", "image", "Windows bitmap", [], ["bmp"], True, 10),
    Format("JPEG", "image", "JPEG image", [], ["jpg", "jpeg"], False, 10),
    Format("TGA", "image", "Truevision TGA", [0], ["tga"], True),
    Format("GIF", "image", "Graphics Interchange Format", [magic(b"GIF8")], ["gif"]),
    Format("TIFF", "image", "Tagged Image File Format", [magic(b"II*\0"), magic(b"MM\0*")], ["tif", "tiff"]),
    Format("PSD", "image", "Layered image", [magic(b"8BPS")], ["psd"]),
    Format("DDS", "image", "DirectDraw surface", [magic(b"DDS ")], ["dds"]),
    Format("WEBP", "image", "WebP image", [magic(b"RIFF")], ["webp"]),
    Format("ZIP", "archive", "PKWare archive", [magic(b"PK\3\4"), magic(b"PK\5\6")], ["zip", "vndat"], True, 0, True),
    Format("XP3", "archive", "Segmented archive", [magic(b"XP3\r")], ["xp3"], True, 0, True),
    Format("NSA", "archive", "Big-endian index archive", [0], ["nsa", "dat"], True, 0, True),
    Format("SAR", "archive", "Big-endian index archive without compression", [0], ["sar"], True, 0, True),
    Format("CPK", "archive", "Archive indexed by typed tables", [magic(b"CPK ")], ["cpk"], False, 0, True),
    Format("RPA", "archive", "Archive with a pickled index", [magic(b"RPA-")], ["rpa"], True, 0, True),
    Format("WILL", "archive", "Archive grouped by extension", [0], ["arc"], True),
    Format("AFA", "archive", "Archive with a packed index", [magic(b"AFAH")], ["afa"], False, 0, True, ["QNT", "AJP", "OGG"]),
    Format("WAV", "audio", "Wave audio", [magic(b"RIFF")], ["wav"], True),
    Format("OGG", "audio", "Ogg stream", [magic(b"OggS")], ["ogg"]),
    Format("MP3", "audio", "MPEG audio", [0], ["mp3"]),
    Format("AIFF", "audio", "Audio interchange file", [magic(b"FORM")], ["aif", "aiff"]),
    Format("TXT", "script", "Plain text", [0], ["txt"]),
    Format("SCR", "script", "Script", [0], ["scr"]),
    Format("DAT/GENERIC", "", "Unidentified data", [0], ["dat"]),
)


def formats(spark: SparkSession) -> DataFrame:
    """One row per registered format, with ord: its place in the registry."""
    rows = [(*f.row(), i) for i, f in enumerate(_REGISTRY.values())]
    return spark.createDataFrame(rows, FORMATS_SCHEMA + ", ord int")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e.lower(), t, k) for e, t, k in ALIASES], "extension string, target string, type string")


def schemes(spark: SparkSession, path: str, newer_than: int = -1) -> DataFrame:
    """tag, params (JSON text) of a parameter table (Parquet: version, tag, params), if it is newer."""
    return spark.read.parquet(path).filter(F.col("version") > newer_than).select("tag", "params")


def writable(fmts: DataFrame) -> DataFrame:
    return fmts.filter("can_write")


def lookup_side(dim: DataFrame) -> DataFrame:
    """dim, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(dim) if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dim


def kind_order(type_col: str = "type"):
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(F.col(type_col) == k, i).otherwise(out)
    return out


def signature_map(fmts: DataFrame) -> DataFrame:
    return fmts.select(F.explode("signatures").alias("signature"), "tag", "type", "priority")


def extension_map(fmts: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """extension, tag, type, priority; aliases add extensions to their target's type only."""
    own = fmts.select(F.explode("extensions").alias("extension"), "tag", "type", "priority")
    if alias is None:
        return own
    more = alias.select("extension", F.col("target").alias("tag"), F.col("type").alias("only")).join(fmts.select("tag", "type", "priority"), "tag")
    more = more.filter(F.col("only").isNull() | (F.col("only") == F.col("type"))).select("extension", "tag", "type", "priority")
    return own.unionByName(more)


def type_of_extension(fmts: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """extension, type: that of the first registered format (image, archive, audio, script; priority; tag)."""
    w = Window.partitionBy("extension").orderBy(kind_order(), F.desc("priority"), "tag")
    return extension_map(fmts, alias).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("extension", "type")
