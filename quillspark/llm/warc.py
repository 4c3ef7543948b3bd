"""WARC derivatives: from each response a metadata record and a plain-text conversion, linked to it and to each other.

Both refer to the response by its record id (WARC-Refers-To), name its target and date, and carry the digests of its
payload and block as the source gives them; the metadata record also holds the response's HTTP headers, whether the
payload agrees with its digest, its title and its links. Payloads are bytes: a chunked or compressed body is undone and decoded by its
charset for the text alone. Record ids follow from the response's id, so a task that runs again makes the same records.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, slices

VERSION = "WARC/1.1"
#: To the end of the page where the end is missing.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Without what _HIDDEN finds. Where the end is missing, these tags count as nothing; a title ends at the next tag then.
_ASIDE = re.compile(r"<(noscript|template)\b[^>]*>.*?</\1\s*>|<title\b[^>]*>(?:.*?</title\s*>|[^<]*)", re.S | re.I)
#: What is left of the head then: it ends at its end tag, or before text or the first tag that can't stand in it.
_HEAD = re.compile(r"<head\b[^>]*>(?:\s|<(?:base|basefont|bgsound|link|meta)\b[^>]*>|</?(?:noscript|template)\b[^>]*>)*(?:</head\s*>)?", re.I)
_START = re.compile(rb"\r\n(?=WARC/\d)")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_META = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Fixed value: so many bytes of a page are searched for its charset, as browsers do.
_SNIFFED = 1024
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
_BLANK = re.compile(r"[^\S\n]+")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    """A labelled digest as WARC files have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """The visible text: without scripts, styles, comments and the head; block elements end lines; runs of blanks are one."""
    shown = _HEAD.sub(" ", _ASIDE.sub(" ", _HIDDEN.sub(" ", page)))
    shown = _TAG.sub("", _BREAK.sub("\n", shown))
    lines = (x.strip() for x in _BLANK.sub(" ", html.unescape(shown)).split("\n"))
    return "\n".join(x for x in lines if x)


#: A payload that unpacks to more is cut there: a small response may stand for any number of bytes.
MOST_UNPACKED = 1 << 28


def header(http_headers: str, name: str) -> str:
    """The last value of an HTTP header, or the empty text."""
    found = ""
    for line in http_headers.split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name:
            found = value.strip()
    return found


def _dechunked(body: bytes) -> bytes:
    """The body of a chunked message; what isn't chunked, though it is said to be, stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return body if not out else b"".join(out)
        if not (n := int(size, 16)):
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _inflated(body: bytes, coding: str) -> bytes:
    """The body without gzip or deflate; cut short where it is damaged or unpacks to more than MOST_UNPACKED bytes, and as it is if it isn't compressed."""
    for bits in (47,) if coding == "gzip" else (15, -15):
        out, rest = [], body
        try:
            while rest and (left := MOST_UNPACKED - sum(map(len, out))) > 0:
                one = zlib.decompressobj(bits)
                out.append(one.decompress(rest, left))
                rest = one.unused_data
        except zlib.error:
            pass
        if out:
            return b"".join(out)
    return body


def decoded(payload: bytes, http_headers: str) -> str:
    """The payload as text: transfer and content codings undone, in the charset of its byte order mark, its header, its meta element, or UTF-8; bytes that don't fit are U+FFFD.

    Latin-1 and ASCII are read as windows-1252, as browsers do. A coding other than gzip and deflate is left as it is.
    """
    codings = [*header(http_headers, "content-encoding").lower().split(","), *header(http_headers, "transfer-encoding").lower().split(",")]
    for coding in reversed([x.strip().removeprefix("x-") for x in codings]):  # the last one was done last
        if coding == "chunked":
            payload = _dechunked(payload)
        elif coding in ("gzip", "deflate"):
            payload = _inflated(payload, coding)
    for mark, name in _BOMS:
        if payload.startswith(mark):
            return payload[len(mark) :].decode(name, "replace")
    said, meta = _CHARSET.search(header(http_headers, "content-type")), _META.search(payload[:_SNIFFED])
    for name in (said and said[1], meta and meta[1].decode()):
        try:
            if name and (known := codecs.lookup(name)) and known._is_text_encoding:
                return payload.decode("cp1252" if known.name in ("iso8859-1", "ascii") else known.name, "replace")
        except (LookupError, UnicodeError):
            continue
    return payload.decode("utf-8", "replace")


class Derived(NamedTuple):
    record_type: str
    record_id: str
    refers_to: str
    concurrent_to: str | None
    target_uri: str | None
    warc_date: str | None
    content_type: str
    content_length: int
    block_digest: str
    source_payload_digest: str
    source_block_digest: str | None
    source_headers: str | None
    block: str


def derive_one(record_id: str, target_uri: str | None = None, warc_date: str | None = None, http_headers: str | None = None, payload: bytes | None = None, payload_digest: str | None = None, block_digest: str | None = None) -> tuple[Derived, Derived]:
    """The metadata record and the conversion record of one response. The source's digests are carried on; where it has none of the payload, one is computed."""
    payload, headers = payload or b"", http_headers or ""
    computed = digest(payload)
    page = decoded(payload, headers)
    source = payload_digest or computed
    ids = [f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{kind}')}>" for kind in ("metadata", "conversion")]
    text = plain_text(page)
    title = _TITLE.search(page)
    links = [html.unescape(a or b or c) for a, b, c in _LINK.findall(page)]
    status, *fields = headers.split("\r\n")
    named = [x.partition(":") for x in fields if ":" in x]
    about = {
        "refers-to": record_id,
        "conversion": ids[1],
        "status-line": status,
        "headers": [[k.strip(), v.strip()] for k, _, v in named],
        "payload-digest": source,
        "payload-agrees": source.lower() == computed.lower() if source.lower().startswith("sha1:") else None,
        "payload-length": len(payload),
        "title": _BLANK.sub(" ", html.unescape(title[1])).strip() if title else None,
        "links": links,
    }
    out = []
    for i, (kind, mime, block) in enumerate((("metadata", "application/json", json.dumps(about, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", text))):
        data = block.encode("utf-8", "replace")
        out.append(Derived(kind, ids[i], record_id, record_id if kind == "metadata" else None, target_uri, warc_date, mime, len(data), digest(data), source, block_digest, http_headers, data.decode()))
    return tuple(out)


def serialised(record: Derived) -> bytes:
    """A record as it stands in a WARC file."""
    fields = [("WARC-Type", record.record_type), ("WARC-Record-ID", record.record_id), ("WARC-Refers-To", record.refers_to), ("WARC-Concurrent-To", record.concurrent_to), ("WARC-Target-URI", record.target_uri), ("WARC-Date", record.warc_date), ("WARC-Block-Digest", record.block_digest), ("Content-Type", record.content_type), ("Content-Length", record.content_length)]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + record.block.encode() + b"\r\n\r\n"


#: A record that says it is longer is broken; so is one whose head doesn't end within _HEAD_ENDS bytes.
_LONGEST, _HEAD_ENDS = (1 << 31) - 1, 1 << 20


class _Unzipped:
    """What a file of gzip members unpacks to, read a little at a time; ends where it is damaged."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.rest, self.one = file, b"", None

    def read(self, size: int) -> bytes:
        while True:
            self.rest = self.rest or self.file.read(size)
            if not self.rest:
                return b""
            self.one = self.one or zlib.decompressobj(31)
            try:
                out = self.one.decompress(self.rest, size)
            except zlib.error:
                return b""
            if self.one.eof:
                self.rest, self.one = self.one.unused_data.lstrip(b"\0"), None
            else:
                self.rest = self.one.unconsumed_tail
            if out:
                return out


def streamed(file: BinaryIO, skipped: Callable[[int], None] | None = None, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with names in lower case, block) of each record of a WARC file, compressed by record or as a whole or not, holding one record at a time.

    A record's Content-Length says where it ends, whatever its block quotes. A broken record is left out up to the next record's start;
    ``skipped`` is told its bytes.
    """
    held, over = bytearray(file.read(max(size, 2))), False
    if held[:2] == b"\x1f\x8b":
        start = bytes(held)
        file = _Unzipped(_Chained(start, file))
        held = bytearray(file.read(size))

    def fill(n: int) -> bool:
        nonlocal over
        while len(held) < n and not over:
            part = file.read(size)
            held.extend(part)
            over = not part
        return len(held) >= n

    while fill(1):
        end, n = -1, size
        while end < 0 and n <= _HEAD_ENDS and fill(1):
            whole = fill(n)
            end, n = held.find(b"\r\n\r\n"), 2 * n if whole else _HEAD_ENDS + 1
        first, *lines = held[: max(end, 0)].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = headers.get("content-length", "")
        if first.startswith("WARC/") and length.isdigit() and int(length) <= _LONGEST and fill(upto := end + 4 + int(length)):
            yield headers, bytes(held[end + 4 : upto])
            del held[:upto]
            while fill(2) and held[:2] == b"\r\n":
                del held[:2]
            continue
        gone, place = 0, 1
        while not (start := _START.search(held, place)) and not over:  # all goes but what may be the beginning of a start
            cut, place = max(0, len(held) - 16), 0 if len(held) > 16 else place
            gone += cut
            del held[:cut]
            fill(len(held) + size)
        cut = start.end() if start else len(held)
        if skipped and held.strip(b"\r\n") or gone and skipped:
            skipped(gone + cut)
        del held[:cut]


class _Chained:
    """A file whose beginning was read already."""

    def __init__(self, start: bytes, file: BinaryIO) -> None:
        self.start, self.file = start, file

    def read(self, size: int) -> bytes:
        out, self.start = self.start, b""
        return out or self.file.read(size)


def records(data: bytes, skipped: Callable[[int], None] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """streamed() over the bytes of a file."""
    return streamed(io.BytesIO(data), skipped)


_RESPONSE = ("warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-block-digest")
_RESPONSE_FIELDS = "record_id string, target_uri string, warc_date string, payload_digest string, block_digest string, http_headers string, payload binary"


def _responses(found: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    found = [(h, *b.partition(b"\r\n\r\n")[::2]) for h, b in found if h.get("warc-type") == "response"]
    cols = [pa.array([h.get(k) for h, _, _ in found], pa.string()) for k in _RESPONSE]
    cols += [pa.array([head.decode("latin-1") for _, head, _ in found], pa.string()), pa.array([body for _, _, body in found], pa.binary())]
    return pa.record_batch(cols, [x.split()[0] for x in _RESPONSE_FIELDS.split(", ")])


def read_responses(spark: SparkSession, path: str, skipped: Accumulator | None = None, whole_files: bool = False) -> DataFrame:
    """The response records in WARC files, with the columns that derive() takes: ids, digests and HTTP headers as they stand there, payloads as bytes.

    A record's Content-Length says where it ends, so a page that quotes WARC records is one response. A task reads one file, plain or .gz, as a
    stream and holds one record at a time; that needs a file system that pyarrow opens by address. For others ``whole_files`` reads
    through Spark, each file in the memory of one task; the rows are the same. (Spark's text reader, cutting files at records' starts, can't tell
    quoted ones, and loses pieces where a part of a file begins within such a cut.) A broken record is left out and the next one read; ``skipped`` counts
    those left out, again in a task that runs again.
    """
    tell = skipped and (lambda _: skipped.add(1))

    def batched(found: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for record in found:
            some.append(record)
            size += len(record[1])
            if len(some) >= 128 or size > 1 << 24:
                yield _responses(some)
                some, size = [], 0
        yield _responses(some)

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", name))
                with system.open_input_stream(place, compression=None) as file:
                    yield from batched(streamed(file, tell))

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield from batched(records(part.column(0)[0].as_py(), tell))

    files = spark.read.format("binaryFile").load(path)
    if whole_files:
        return mapped(files.select("content"), wholes, _RESPONSE_FIELDS)
    names = files.select("path")  # the contents aren't read
    return mapped(names.repartition(max(1, names.count()), "path"), streams, _RESPONSE_FIELDS)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Pages as responses, with ``key`` beside the columns that derive() takes: ids from key and URL; no dates, headers and digests, since pages have none."""
    name = F.sha1(F.concat_ws("|", F.coalesce(pages[key].cast("string"), F.lit("null")), F.coalesce(pages[url], F.lit(""))).cast("binary"))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    record_id = F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-5"), parts[2], F.lit("-8"), parts[3], F.lit("-"), parts[4], F.lit(">"))
    none = F.lit(None).cast("string")
    return pages.select(pages[key].alias(key), record_id.alias("record_id"), pages[url].alias("target_uri"), none.alias("warc_date"), none.alias("payload_digest"), none.alias("block_digest"), none.alias("http_headers"), pages[page].cast("binary").alias("payload"))


FIELDS = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_block_digest string, source_headers string, block string"


def derive(source: DataFrame, key: str | None = None) -> DataFrame:
    """Two rows for each response, metadata first, with the columns of Derived, after ``key`` if given.

    A null payload counts as empty: its conversion has an empty block. Null targets, dates, headers and block digests stay null.
    Repeated responses give repeated records with the same ids; no rows give no rows. Other columns are left out, so their
    names can't clash.
    """
    lead = [F.lit(0).alias("key") if key is None else source[key].alias("key")]
    rows = source.select(*lead, "record_id", "target_uri", "warc_date", "http_headers", F.col("payload").cast("binary").alias("payload"), "payload_digest", "block_digest")
    names = ["key", *(x.split()[0] for x in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                made = [x for r in zip(*(part.column(i).to_pylist() for i in range(1, 8)), strict=True) for x in derive_one(*r)]
                at = pa.array([i for i in range(part.num_rows) for _ in range(2)])
                cols = [pa.array(c, pa.int64() if n == "content_length" else pa.string()) for n, c in zip(names[1:], zip(*made, strict=True), strict=True)]
                yield pa.record_batch([part.column(0).take(at), *cols], names)

    found = mapped(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, {FIELDS}")
    return found.drop("key") if key is None else found.withColumnRenamed("key", key)
