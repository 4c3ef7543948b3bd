"""Packed files by their structure."""

import struct
import zlib

import pytest

from quillspark.functions import containers, gate
from quillspark.plans import packed


@pytest.mark.parametrize("kind", packed.FORMATS)
def test_whole_cut_and_forged(kind):
    plain = kind[:3] if kind.startswith("rar") else kind
    assert gate.kind_of(packed.made(kind, "text " * 300, 0)) == gate.kind_of(packed.made(kind, "", 0)) == plain
    for harm in (1, 2):
        assert gate.kind_of(packed.made(kind, "text " * 300, harm)) in ("ole", "invalid_zip", "invalid_rar", "invalid_7z")


def test_every_cut_and_every_changed_byte_is_read_without_error():
    for kind in packed.FORMATS:
        body = packed.made(kind, "ab", 0)
        for n in range(0, len(body), 1 if len(body) < 600 else 7):
            gate.kind_of(body[:n])
            gate.kind_of(body[:n] + bytes([body[n] ^ 0xFF]) + body[n + 1 :])


def test_signatures_alone_are_no_files():
    assert gate.kind_of(b"Rar!\x1a\x07\x00") == gate.kind_of(b"Rar!\x1a\x07\x01\x00") == "invalid_rar"
    assert gate.kind_of(b"7z\xbc\xaf\x27\x1c") == "invalid_7z"
    assert gate.kind_of(b"PK\x05\x06" + bytes(18)) == "invalid_zip"  # an archive of nothing
    assert gate.kind_of(containers.COMPOUND + "Book".encode("utf-16-le") * 400) == "ole"


def test_compound_files():
    both = packed.compound("WordDocument", "Workbook")
    assert gate.kind_of(both) == "ole" and containers.compound_names(both) == {"root entry", "worddocument", "workbook"}
    assert gate.kind_of(packed.compound("Other")) == "ole"
    assert gate.kind_of(packed.compound("bOOK")) == "xls"
    # sectors of 4096 bytes, and a table of tables that leads to the one table
    small = packed.compound("WordDocument")
    head, fat, directory = small[:512], small[512:1024], small[1024:]
    big = bytearray(head.ljust(4096, b"\0") + fat.ljust(4096, b"\xff") + directory.ljust(4096, b"\0") + struct.pack("<I", 0).ljust(4092, b"\xff") + struct.pack("<I", 0xFFFFFFFE))
    struct.pack_into("<H", big, 0x1E, 12)
    struct.pack_into("<II", big, 0x44, 2, 1)
    big[0x4C:512] = b"\xff" * (512 - 0x4C)
    assert gate.kind_of(bytes(big)) == "doc"
    struct.pack_into("<I", big, 0x44, 77)
    assert gate.kind_of(bytes(big)) == "ole"


def test_archives_that_no_honest_file_is():
    assert gate.kind_of(packed.archive(**{"a.txt": "x" * 3_000_000})) == "invalid_zip"  # over a thousand times its size
    assert gate.kind_of(packed.archive(**{"a/": "", "b.txt": ""})) == "invalid_zip"
    assert gate.kind_of(packed.archive(**{"a.txt": "x"})) == "zip"
    whole = packed.archive(**{"[Content_Types].xml": "<Types/>", "word/document.xml": "<w/>"})
    assert gate.kind_of(whole) == "docx" and gate.kind_of(whole[:-30]) == "invalid_zip"


def test_headers_of_rar_with_long_numbers():
    main = b"\x85\x80\x80\x00\x01\x00\x00\x00\x00"  # a size of five bytes, written in four
    good = b"Rar!\x1a\x07\x01\x00" + struct.pack("<I", zlib.crc32(main)) + main
    assert gate.kind_of(good + b"more") == "rar"
    other = main[:4] + b"\x02" + main[5:]
    assert gate.kind_of(good[:8] + struct.pack("<I", zlib.crc32(other)) + other) == "invalid_rar"
    assert gate.kind_of(b"Rar!\x1a\x07\x01\x00" + bytes(4) + b"\xff" * 12) == "invalid_rar"


def test_gate_refuses_what_only_claims_to_be_an_archive(spark):
    rows = [(n, harm, kind) for n, (kind, harm) in enumerate((k, h) for k in packed.FORMATS for h in (0, 1, 2))]
    media = {v: k for k, v in gate.MEDIA.items()}
    items = [
        (n, "official", "https://a.example.com/f", f"https://a.example.com/f.{plain}", media[plain], packed.made(kind, "text", harm), None, "", "", "", "附件")
        for n, harm, kind in rows
        for plain in [kind[:3] if kind.startswith("rar") else kind]
    ]
    schema = "n int, source_role string, origin string, final_url string, content_type string, body binary, analysis_body binary, expected_title string, expected_buyer string, expected_project_code string, document_kind string"
    found = {r["n"]: r for r in gate.verdicts(spark.createDataFrame(items, schema), trusted=("a.example.com",)).collect()}
    for n, harm, kind in rows:
        codes = found[n]["error_codes"]
        if harm:
            assert {"mime_magic_mismatch", "unsupported_media_type", "document_kind_mismatch"} <= set(codes), (kind, harm, codes)
        elif kind != "docx":
            assert found[n]["verdict"] == "allow", (kind, codes)
