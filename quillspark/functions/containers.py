"""Packed files by their structure: whether what a signature promises is there, without unpacking anything.

Each function takes the bytes of a whole file and never raises for what is in them. Reading is bounded by the file's own
length: chains that come back to a sector end the reading, and sizes that a header states are compared before they are used.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np

# Signatures, and the most that an archive may hold.
ZIP = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
COMPOUND = bytes.fromhex("d0cf11e0a1b11ae1")
RAR4, RAR5 = b"Rar!\x1a\x07\x00", b"Rar!\x1a\x07\x01\x00"
SEVEN = b"7z\xbc\xaf\x27\x1c"
MOST_ENTRIES, MOST_BYTES, MOST_RATIO, MOST_MAIN = 100_000, 4 << 30, 1000, 16 << 20

#: The first 512 bytes of a compound file.
_HEADER = np.dtype(
    [("signature", "S8"), ("id", "V16"), ("minor", "<u2"), ("major", "<u2"), ("order", "<u2"), ("shift", "<u2"), ("mini_shift", "<u2"), ("unused", "V6"), ("n_directory", "<u4"), ("n_fat", "<u4"), ("directory", "<u4")]
    + [("transaction", "<u4"), ("cutoff", "<u4"), ("mini_fat", "<u4"), ("n_mini_fat", "<u4"), ("difat", "<u4"), ("n_difat", "<u4"), ("fat", "<u4", 109)]
)
_ENTRY = np.dtype([("name", "V64"), ("name_bytes", "<u2"), ("kind", "u1"), ("rest", "V61")])
#: Numbers of sectors from here on are marks; this one ends a chain.
_MARKS, _END = 0xFFFFFFFC, 0xFFFFFFFE


class Broken(ValueError):
    """A file that isn't what its signature promises."""


def _chain(first: int, follows: np.ndarray) -> Iterator[int]:
    """Sectors from ``first`` to the end mark."""
    seen = 0
    while first != _END:
        if first >= len(follows) or (seen := seen + 1) > len(follows):
            raise Broken("a chain leaves the file or comes back")
        yield first
        first = int(follows[first])


def compound_names(body: bytes) -> set[str]:
    """The case-folded names of storages and streams in a compound file's directory; none if it can't be read to its end."""
    try:
        return _directory(body)
    except (Broken, UnicodeDecodeError):
        return set()


def _directory(body: bytes) -> set[str]:
    if len(body) < 3 * _HEADER.itemsize or body[:8] != COMPOUND:
        raise Broken("no header")
    head = np.frombuffer(body, _HEADER, 1)[0]
    if head["order"] != 0xFFFE or head["shift"] not in (9, 12):
        raise Broken("not little-endian, or sectors of another size")
    size = 1 << int(head["shift"])
    n = len(body) // size - 1
    if n < 1:
        raise Broken("no sector")
    sectors = np.frombuffer(body, np.uint8, n * size, size).reshape(n, size)
    numbers = lambda at: sectors[at].view("<u4")
    tables, at, links = list(head["fat"]), int(head["difat"]), int(head["n_difat"])
    if links > n:
        raise Broken("more tables than sectors")
    for _ in range(links):
        if at >= n:
            raise Broken("a table outside the file")
        tables += list(numbers(at)[:-1])
        at = int(numbers(at)[-1])
    tables = [int(x) for x in tables if x < _MARKS][: int(head["n_fat"])]
    if len(tables) < head["n_fat"] or any(x >= n for x in tables):
        raise Broken("tables are missing")
    fat = np.concatenate([numbers(x) for x in tables] or [np.empty(0, "<u4")])
    run = list(_chain(int(head["directory"]), fat))
    if any(x >= n for x in run):
        raise Broken("the directory is cut")
    entries = sectors[run].reshape(-1).view(_ENTRY)
    lengths = entries["name_bytes"]
    named = np.isin(entries["kind"], (1, 2, 5)) & (lengths >= 2) & (lengths <= 64) & (lengths % 2 == 0)
    return {bytes(e["name"])[: int(e["name_bytes"]) - 2].decode("utf-16-le").casefold() for e in entries[named]}


def zip_names(body: bytes) -> dict[str, int] | None:
    """Names and unpacked sizes of a ZIP file; null if it is none, holds nothing, is cut, or would unpack to what no honest file does."""
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as archive:
            entries = archive.infolist()
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
        return None
    files = [e for e in entries if not e.is_dir()]
    if len(entries) > MOST_ENTRIES or not any(e.file_size for e in files) or sum(e.file_size for e in entries) > MOST_BYTES:
        return None
    for e in entries:
        if e.file_size > (MOST_RATIO * e.compress_size if e.compress_size else 1024):
            return None
    for e in files:
        head = body[e.header_offset : e.header_offset + 30] if e.header_offset >= 0 else b""
        if len(head) < 30 or head[:4] != ZIP[0]:
            return None
        if e.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little") + e.compress_size > len(body):
            return None
    return {e.filename: e.file_size for e in entries}


def zip_kind(body: bytes) -> str:
    names = zip_names(body)
    if names is None:
        return "invalid_zip"
    if "[Content_Types].xml" in names:
        for kind, main in (("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml")):
            if main in names:
                return kind if names[main] <= MOST_MAIN else "zip"
    return "zip"


def compound_kind(body: bytes) -> str:
    """doc or xls by the one stream that says so; ole where neither is there, or both."""
    names = compound_names(body)
    word, book = "worddocument" in names, not names.isdisjoint({"workbook", "book"})
    return "doc" if word > book else "xls" if book > word else "ole"


def base128(body: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, least first, and where it ends."""
    value = 0
    for n, byte in enumerate(body[at : at + 10]):
        value |= (byte & 127) << (7 * n)
        if byte < 128:
            return value, at + n + 1
    raise Broken("a number without end")


def rar_header_fits(body: bytes) -> bool:
    """Whether the first header after a RAR signature, of either generation, is a main header with the check sum that it states."""
    if body[:7] == RAR4:
        end = 7 + int.from_bytes(body[12:14], "little")
        return len(body) >= 20 <= end <= len(body) and body[9] == 0x73 and zlib.crc32(body[9:end]) & 0xFFFF == int.from_bytes(body[7:9], "little")
    try:
        size, start = base128(body, 12)
        kind, after = base128(body, start)
    except Broken:
        return False
    return kind == 1 and after <= start + size <= len(body) and zlib.crc32(body[12 : start + size]) == int.from_bytes(body[8:12], "little")


def seven_headers_fit(body: bytes) -> bool:
    """Whether both headers of a 7z file, at its start and where that says, have their check sums."""
    if len(body) < 32 or zlib.crc32(body[12:32]) != int.from_bytes(body[8:12], "little"):
        return False
    start, size, check = (int.from_bytes(body[a:b], "little") for a, b in ((12, 20), (20, 28), (28, 32)))
    return 32 + start + size <= len(body) and zlib.crc32(body[32 + start : 32 + start + size]) == check


def packed_kind(body: bytes) -> str | None:
    """zip, docx, xlsx, doc, xls, ole, rar, 7z, or invalid_ and the format that a signature promises in vain; null for other files."""
    if body[:4] in ZIP:
        return zip_kind(body)
    if body[:8] == COMPOUND:
        return compound_kind(body)
    if body[:7] == RAR4 or body[:8] == RAR5:
        return "rar" if rar_header_fits(body) else "invalid_rar"
    if body[:6] == SEVEN:
        return "7z" if seven_headers_fit(body) else "invalid_7z"
    return None
