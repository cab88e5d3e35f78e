"""Containers of fixed records, as data for containers.Layout.

To add one, add a row; the interpreter, the writer and the tests take it from
here.
"""

from __future__ import annotations

from holdfast.sources.containers import READERS, Layout

#: AT((place, width)): a number that stands in the head.
AT = tuple

# fixed values of the formats: tag, magic, count, first record (or where it is said), record size, name (place, size),
# offset (place, width; None: members follow each other), size (place, width; None: to the next offset), base of offsets
TABLE = [
    ("ACPXPK", b"ACPXPK01", (8, 4), 0x0C, 0x28, (0, 0x20), (0x20, 4), (0x24, 4), 0),
    ("AGS", b"pack", (4, 2), 6, 0x18, (0, 0x10), (0x10, 4), (0x14, 4), 0),
    ("ALPHA", b"", (0, 4), 4, 0x30, (0, 0x20), (0x2C, 4), (0x24, 4), 0),
    ("APPLEPIE", b"ARC\x10", (4, 4), AT((0x0C, 4)), 0x18, (0, 0x10), (0x14, 4), (0x10, 4), 0),
    ("ARC0", b"ARC0", (8, 4), 0x10, 0x20, (0x0C, 0x14), (0, 4), (4, 4), 0),
    ("ARC1", b"ARC1", (4, 4), AT((8, 4)), 0x18, (0, 0x10), (0x14, 4), (0x10, 4), 0),
    ("ARCX/LOWER", b"arcx", (4, 4), 0x10, 0x20, (0, 0x10), (0x14, 4), (0x10, 4), 0),
    ("ARC/BGI", b"PackFile    ", (0x0C, 4), 0x10, 0x20, (0, 0x10), (0x10, 4), (0x14, 4), "end"),
    ("ARC/BURIKO", b"BURIKO ARC20", (0x0C, 4), 0x10, 0x80, (0, 0x60), (0x60, 4), (0x64, 4), "end"),
    ("BISHOP", b"\x8c\x8ePK", (4, 4), 0x0C, 0x230, (0, 0x200), (0x204, 4), (0x208, 4), 0),
    ("BLD", b"BLD0", (8, 2), AT((0x0A, 4)), 0x10, (0, 0x0C), None, (0x0C, 4), 0x10),
    ("CDPA", b"PACK", (4, 4), 8, 0x28, (0, 0x20), (0x24, 4), (0x20, 4), 0),
    ("CLIO", b"", (0, 4), 4, 0x28, (0, 0x20), (0x24, 4), (0x20, 4), 0),
    ("CLS", b"CLS_FILELINK", (0x10, 4), AT((0x18, 4)), 0x40, (0, 0x28), (0x2C, 4), (0x30, 4), 0),
    ("CRG", b"CRG\0", (4, 4), 8, 0x3C, (8, 0x30), (0, 4), (4, 4), 0),
    ("DAF", b"DAF\x1a", (4, 4), 8, 0x20, (8, 0x18), (0, 4), (4, 4), 0),
    ("DL1", b"DL1.0\x1a", (8, 2), AT((0x0A, 4)), 0x10, (0, 0x0C), None, (0x0C, 4), 0x10),
    ("DPF", b"DPFL", (4, 2), 6, 0x18, (0, 0x10), (0x10, 4), (0x14, 4), 0),
    ("ELECTR", b"", (0, 4), 4, 0x2C, (0, 0x10), (0x24, 4), (0x28, 4), 0),
    ("FPACK", b"FPACK\0", (6, 2), 0x10, 0x18, (0, 0x10), (0x10, 4), (0x14, 4), 0),
    ("FPARC", b"FPARC10\0", (0x14, 4), AT((0x10, 4)), 0x30, (0, 0x10), (0x10, 4), (0x14, 4), "end"),
    ("FPK/2.00", b"FPK 2.00", (0x1C, 4), 0x20, 0x20, (8, 0x18), (0, 4), (4, 4), 0),
    ("FPK/MFWY", b"MFWY", (4, 4), 0x10, 0x20, (0, 0x18), (0x1C, 4), (0x18, 4), 0),
    ("GSP", b"", (0, 4), 4, 0x40, (8, 0x38), (0, 4), (4, 4), 0),
    ("IPAC", b"IPAC", (4, 2), 8, 0x2C, (0, 0x20), (0x24, 4), (0x28, 4), 0),
    ("K3", b"K3", (2, 4), 6, 0x40, (0x20, 0x20), (0, 4), (4, 4), "end"),
    ("KAR", b"KAR\0", (4, 4), 0x0C, 0x28, (0, 0x20), (0x24, 4), (0x20, 4), 0),
    ("LNK", b"LNK\0", (4, 4), 0x10, 0x20, (8, 0x18), (0, 4), (4, 4), "end"),
    ("MIF", b"MIF\0", (4, 4), 8, 0x18, (0, 0x10), (0x10, 4), (0x14, 4), 0),
    ("MINK", b"", (0, 4), AT((4, 4)), 0x20, (0, 0x18), (0x18, 4), (0x1C, 4), 0),
    ("MPK", b"MPK\0", (8, 4), 0x48, 0x100, (0x18, 0xE0), (0, 8), (8, 4), 0),
    ("MRG0", b"mrg0", (4, 4), 0x10, 0x4C, (0, 0x40), None, (0x40, 4), AT((8, 4))),
    ("P8", b"", (0, 4), 4, 0x1C, (0, 0x10), (0x18, 4), (0x10, 4), 0),
    ("PHS", b"KPHS", (0x0C, 4), 0x50, 0x14, (0, 0x0C), (0x0C, 4), (0x10, 4), "end"),
    ("PKD/ZONE", b"\1\0\0\0", (4, 4), 0x10, 0x2C, (0, 0x20), (0x20, 4), (0x24, 4), AT((0x0C, 4))),
    ("REDZONE", b"", (0, 4), 4, 0x54, (0, 0x44), (0x44, 4), (0x48, 4), 0),
    ("SAKURA", b"", (0, 4), 0x20, 0x110, (0, 0x100), (0x104, 4), (0x100, 4), 0),
    ("SZS", b"SZS1", (0x0C, 4), 0x10, 0x110, (0, 0x100), (0x100, 8), (0x108, 4), 0),
    ("TEX/LEAF", b"TEX PACK0.02", (0x0C, 4), 0x20, 0x28, (0, 0x20), (0x20, 4), (0x24, 4), "end"),
    ("TIGERMAN", b"\0\0\0\0", (4, 4), 0x14, 0x18, (0, 0x10), (0x10, 4), (0x14, 4), "end"),
    ("UK", b"UK", (2, 2), 4, 0x18, (0, 0x10), (0x10, 4), (0x14, 4), 0),
    ("UNA", b"UNA\x00001\0", (8, 4), 0x20, 0x30, (0, 0x20), (0x20, 4), (0x24, 4), 0),
    ("VFS/VNSYSTEM", b"VFS File\0\0\0\0", (0x0C, 4), 0x10, 0x1C, (0, 0x14), (0x14, 4), (0x18, 4), "end"),
    ("WVX", b"WVX0", (8, 4), 0x10, 0x20, (0, 0x1C), (0x1C, 4), None, 0),
    ("XFL", b"LB\1\0", (8, 4), 0x0C, 0x28, (0, 0x20), (0x20, 4), (0x24, 4), "end"),
    ("YSK", b"AA16", (0x0C, 4), 0x10, 0x18, (0, 0x14), None, (0x14, 4), "end"),
]

LAYOUTS = {row[0]: Layout(*row[:3], records=row[3], record=row[4], name=row[5], offset=row[6], size=row[7], base=row[8]) for row in TABLE}
READERS.update({tag: layout.list for tag, layout in LAYOUTS.items()})
