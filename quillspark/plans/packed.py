"""Queries over packed files that are made from the documents' texts: whole ones, cut ones and forged ones."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F

from ..functions import gate
from ..shipping import vectorised
from .registry import query, table

FORMATS = ("zip", "docx", "xlsx", "doc", "xls", "rar4", "rar5", "7z")


def archive(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def compound(*names: str, text: bytes = b"") -> bytes:
    """A compound file with these streams, all empty, and a sector for each 512 bytes of text after its directory."""
    sectors = -(-len(text) // 512)
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [0xFFFFFFFF] * 126
    head = struct.pack("<8s16sHHHHH6xIIIIIIIIII", bytes.fromhex("d0cf11e0a1b11ae1"), b"", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0)
    directory = b"".join(name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, 2 if n else 5) + bytes(61) for n, name in enumerate(("Root Entry", *names)))
    return head.ljust(512, b"\xff") + struct.pack("<128I", *fat) + directory.ljust(512, b"\0") + text.ljust(512 * sectors, b"\0")


def rar(text: bytes, generation: int = 4) -> bytes:
    """The signature, a main header and text after it."""
    if generation == 4:
        main = b"\x73\x00\x00\x0d\x00" + bytes(6)
        return b"Rar!\x1a\x07\x00" + struct.pack("<H", zlib.crc32(main) & 0xFFFF) + main + text
    main = b"\x83\x00\x01\x00\x00"  # three bytes, written in two: the type, and no flags
    return b"Rar!\x1a\x07\x01\x00" + struct.pack("<I", zlib.crc32(main)) + main + text


def seven(text: bytes) -> bytes:
    """Both headers, text between them."""
    last = b"\x01" + text[:16]
    start = struct.pack("<QQI", len(text), len(last), zlib.crc32(last))
    return b"7z\xbc\xaf\x27\x1c\x00\x04" + struct.pack("<I", zlib.crc32(start)) + start + text + last


def made(kind: str, text: str, harm: int) -> bytes:
    """A file of a kind: whole (0), cut (1), or with one thing changed that its structure depends on (2)."""
    data = text.encode()
    if kind in ("zip", "docx", "xlsx"):
        main = {"zip": {}, "docx": {"[Content_Types].xml": "<Types/>", "word/document.xml": text + "."}, "xlsx": {"[Content_Types].xml": "<Types/>", "xl/workbook.xml": text + "."}}[kind]
        body = archive(**main, **{"first.txt": text + ".", "second.txt": "x"})
        at = body.rindex(b"PK\x03\x04")
    elif kind in ("doc", "xls"):
        body, at = compound("WordDocument" if kind == "doc" else "Workbook", text=data), 512 + 4
        if harm == 2:  # the directory's chain comes back to itself
            return body[:at] + struct.pack("<I", 1) + body[at + 4 :]
    else:
        body = seven(data) if kind == "7z" else rar(data, int(kind[3]))
        at = 15 if kind == "7z" else 10 if kind == "rar4" else 12
    if harm == 1:
        return body[: 1100 if kind in ("doc", "xls") else 16 if kind == "rar4" else 15 if kind == "rar5" else len(body) - 1]
    return body[:at] + bytes([body[at] ^ 1]) + body[at + 1 :] if harm else body


@vectorised("binary")
def packed_body(kind: pd.Series, text: pd.Series, harm: pd.Series) -> pd.Series:
    return pd.Series([made(k, t, int(h)) for k, t, h in zip(kind, text, harm)])


_FORMAT = f"['{"', '".join(FORMATS)}'][1 + doc_id % 8]"


@query(f"""with f as (select doc_id, {_FORMAT} as made, (doc_id // 8) % 3 as harm from documents where doc_id >= 0)
select doc_id, made, case when harm = 0 then regexp_replace(made, '^rar.', 'rar') when made in ('doc', 'xls') then 'ole' when made like 'rar%' then 'invalid_rar' when made = '7z' then 'invalid_7z' else 'invalid_zip' end as kind,
harm = 0 as deliverable from f""")
def container_kinds(spark, d):
    """What the gate finds in files of eight kinds, of which two thirds are cut or forged, and which it lets through."""
    n = F.col("doc_id")
    kinds = F.array(*(F.lit(x) for x in FORMATS))
    rows = table(spark, d, "documents").where("doc_id >= 0").select("doc_id", F.element_at(kinds, (1 + n % 8).cast("int")).alias("made"), F.coalesce("text", F.lit("")).alias("text"), (F.floor(n / 8) % 3).alias("harm"))
    found = rows.select("doc_id", "made", gate.detected_kind(packed_body("made", "text", "harm")).alias("kind"))
    return found.select("doc_id", "made", "kind", F.col("kind").isin(*gate.FILES).alias("deliverable"))
