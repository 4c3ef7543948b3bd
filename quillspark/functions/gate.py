"""Content gate: what bytes really are, and whether that fits what was declared and expected."""

from __future__ import annotations

import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import in_parts, vectorised, vectorised_in_parts
from . import containers, html, urls

# Media types by what they declare.
MEDIA = {
    "text/html": "html", "application/xhtml+xml": "html", "application/json": "json", "text/json": "json", "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/msword": "doc", "application/vnd.ms-excel": "xls", "application/zip": "zip", "application/x-zip-compressed": "zip",
    "application/vnd.rar": "rar", "application/x-rar-compressed": "rar", "application/x-7z-compressed": "7z",
}
GENERIC = ("", "application/octet-stream", "application/download", "application/x-download", "binary/octet-stream")
KINDS = {
    "html": "html", "official_html": "html", "official_page": "html", "官方网页": "html", "网页": "html", "json": "json", "official_json": "json", "官方json": "json",
    "pdf": "pdf", "docx": "docx", "doc": "doc", "xls": "xls", "xlsx": "xlsx", "zip": "zip", "rar": "rar", "7z": "7z",
}
ATTACHMENTS = ("attachment", "official_attachment", "附件", "官方附件", "招标文件", "采购文件")
NOTICES = {
    "采购意向": ("采购意向",),
    "招标公告": ("招标公告", "公开招标", "邀请招标"),
    "采购公告": ("采购公告", "招标公告", "竞争性磋商", "竞争性谈判", "询价公告"),
    "中标公告": ("中标公告", "中标结果", "成交公告", "成交结果"),
    "成交公告": ("成交公告", "成交结果", "中标公告", "中标结果"),
    "合同公告": ("合同公告", "采购合同"),
    "更正公告": ("更正公告", "变更公告", "澄清公告"),
    "废标公告": ("废标公告", "终止公告", "流标公告"),
}
FILES = ("pdf", "doc", "docx", "xls", "xlsx", "zip", "rar", "7z")
SUFFIXES = {"html": "html", "htm": "html", "json": "json"} | {x: x for x in FILES}


def kind_of(body: bytes | None) -> str:
    """html, json, pdf, docx, xlsx, zip, doc, xls, rar, 7z, empty or unknown, by signature and structure; invalid_zip, invalid_rar, invalid_7z and ole where the structure isn't what the signature promises."""
    if not body:
        return "empty"
    if body[:5] == b"%PDF-":
        return "pdf"
    packed = containers.packed_kind(body)
    if packed:
        return packed
    start = body[:4096].removeprefix(b"\xef\xbb\xbf").lstrip()
    if start[:1] in (b"{", b"["):
        return "json"
    if re.match(rb"(?:<\?xml[^>]*\?>\s*)?(?:<!--.*?-->\s*)*<(?:!doctype\s+html|html|head|body|div|table|p|span|article|section|main|meta|title|script)\b", start, re.I | re.S):
        return "html"
    return "unknown"


@vectorised("string")
def detected_kind(body: pd.Series) -> pd.Series:
    return pd.Series([kind_of(None if x is None else bytes(x)) for x in body])


def normal(value: str) -> str:
    """Compatibility forms folded, case folded, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKC", value).casefold() if c.isalnum())


@vectorised("string")
def normalised(value: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else normal(x) for x in value])


def json_text(body: str) -> str | None:
    """Keys and values of a JSON object or array in order; null if it is neither."""
    try:
        todo = [json.loads(body)]
    except (ValueError, RecursionError):
        return None
    if not isinstance(todo[0], (dict, list)):
        return None
    out = []
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            todo += [x for pair in reversed(node.items()) for x in (pair[1], str(pair[0]))]
        elif isinstance(node, list):
            todo += reversed(node)
        elif node is not None:
            out.append(str(node))
    return " ".join(" ".join(out).split())


def docx_text(body: bytes) -> str | None:
    """The words of a document; null if there are none."""
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as archive:
            xml = archive.read("word/document.xml").decode("utf-8", "replace")
    except (KeyError, OSError, zipfile.BadZipFile):
        return None
    return " ".join(re.sub("<[^>]+>", " ", xml).split()) or None


def shared_runs(a: str, b: str, width: int, least: bool = False) -> float:
    """Distinct runs of so many characters that both have, as a share of those of a, or of the fewer; a shorter text is one run."""
    runs = [{x[i : i + width] for i in range(max(1, len(x) - width + 1))} if x else set() for x in (a, b)]
    return len(runs[0] & runs[1]) / max(1, min(map(len, runs)) if least else len(runs[0]))


READ = "kind string, raw string, shown string, said string, rendered_raw string, title_share double, render_share double, title string, buyer string, code string, wanted string"


def read_one(body: bytes | None, content_type: str, rendered: bytes | None, title: str, buyer: str, code: str, wanted: str) -> tuple:
    """One response with what is expected of it: its kind, raw and visible text, and how much of the title and of the rendered page it has."""
    kind = kind_of(body)
    raw = None if body is None else html.decoded(body, content_type)
    shown = html.parse(raw)["text"] if kind == "html" else json_text(raw) if kind == "json" else docx_text(body) if kind == "docx" else None
    said, title = None if shown is None else normal(shown), normal(title)
    title_share = 1.0 if said is None or title in said else shared_runs(title, said, 2) if len(title) >= 8 else 0.0
    page, render_share = None, 1.0
    if rendered is not None and kind in ("html", "json"):
        page = html.decoded(rendered, content_type)
        a, b = said or "", normal((json_text(page) if kind == "json" else None) or html.parse(page)["text"])
        render_share = (1.0 if a in b or b in a else shared_runs(a, b, 4, least=True)) if a and b else float(a == b)
    return kind, raw, shown, said, page, title_share, render_share, title, normal(buyer), normal(code), unicodedata.normalize("NFKC", wanted).strip().casefold()


@vectorised_in_parts(READ)
def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(body, content type, rendered body, expected title, buyer, code, kind) -> what read_one() gives."""
    for batch in in_parts(batches):
        rows = [read_one(*(bytes(x) if isinstance(x, (bytes, bytearray, memoryview)) else x for x in r)) for r in zip(*batch, strict=True)]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])


def declared(content_type: Column) -> Column:
    """The media type without parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def media_mismatch(kind: Column, content_type: Column, url: Column, body: Column) -> Column:
    """Whether declared type, extension and content disagree; true too for a PDF without its end mark."""
    mime, table = declared(content_type), F.create_map(*(F.lit(x) for p in MEDIA.items() for x in p))
    named = F.create_map(*(F.lit(x) for p in SUFFIXES.items() for x in p))[F.lower(F.regexp_extract(urls.path(url), r"\.([A-Za-z0-9]+)$", 1))]
    by_mime = F.when(mime.endswith("+json"), "json").otherwise(table[mime])
    zipped = (by_mime == "zip") & kind.isin("docx", "xlsx")
    loose = mime.isin(*GENERIC) & kind.isin(*FILES) | (mime == "") & kind.isin("html", "json") & (named.isNull() & (kind == "html") | (named == kind))
    other = (by_mime.isNotNull() & (by_mime != kind) & ~zipped) | (named.isNotNull() & (named != kind))
    wrong = other | (kind.isin("html", "json", *FILES) & by_mime.isNull() & ~F.coalesce(loose, F.lit(False)))
    cut = (kind == "pdf") & ~F.contains(F.substring(body, -4096, 4096), F.lit(b"%%EOF"))
    return F.coalesce(wrong, F.lit(False)) | cut


def verdicts(items: DataFrame, trusted: Sequence[str], redirects: Sequence[tuple[str, str]] = (), aggregators: Sequence[str] = (), least: int = 80) -> DataFrame:
    """items with error_codes, verdict, detected_kind, hosts and hashes.

    items: source_role, origin, final_url, content_type, body, analysis_body, expected_title, expected_buyer,
    expected_project_code, document_kind; nulls count as not given. What is expected is text, without entities. Every rule that is broken adds its code, in order.
    """
    c = F.col
    given = lambda x: F.coalesce(c(x), F.lit(""))
    said = read("body", given("content_type"), "analysis_body", *(given(x) for x in ("expected_title", "expected_buyer", "expected_project_code", "document_kind")))
    rows = items.withColumn("r", said).withColumns({"detected_kind": c("r.kind"), "source_host": urls.host(given("origin")), "final_host": urls.host(given("final_url"))})
    # what rules ask of the two addresses again and again has a projection of its own
    rows = rows.withColumns({f"x_{part}_{x}": of(given(x)) for x in ("origin", "final_url") for part, of in (("scheme", urls.scheme), ("port", urls.port))})
    shows = F.array_union(html.block_kinds(F.when(c("detected_kind").isin("html", "json", "unknown"), c("r.raw"))), html.block_kinds(c("r.rendered_raw")))
    rows = rows.withColumn("blocked", shows)
    source, final, kind, role = c("source_host"), c("final_host"), c("detected_kind"), F.lower(F.trim(given("source_role")))
    scheme, port = lambda x: c(f"x_scheme_{x}"), lambda x: c(f"x_port_{x}")
    ok = lambda x: scheme(x).isin("http", "https") & ((source if x == "origin" else final) != "")
    pair = F.exists(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (redirects or [("", "")]))), lambda p: (p["a"] == source) & (p["b"] == final) & (source != ""))
    known = lambda x: x.isin(*trusted) if trusted else F.lit(False)
    lead = F.exists(F.array(*(F.lit(x) for x in (aggregators or [" "]))), lambda d: urls.matches_domain(source, d) | urls.matches_domain(final, d))
    media = F.create_map(*(F.lit(x) for p in KINDS.items() for x in p))[c("r.wanted")]
    terms = F.create_map(*(x for name, own in NOTICES.items() for x in (F.lit(name), F.array(*(F.lit(t) for t in own)))))[c("r.wanted")]
    spoken = F.coalesce(c("r.said"), F.lit(""))
    other_kind = F.when(media.isNotNull() & (media != kind), True).when(c("r.wanted").isin(*ATTACHMENTS), ~kind.isin(*FILES)).otherwise(terms.isNotNull() & ~F.exists(terms, lambda t: F.contains(spoken, t)))
    semantic = c("r.said").isNotNull()
    rules = (
        ("commercial_aggregator_not_deliverable", (role == "commercial_lead") | lead),
        ("invalid_source_role", ~role.isin("official", "commercial_lead")),
        ("invalid_origin_url", ~ok("origin")),
        ("invalid_final_url", ~ok("final_url")),
        ("insecure_origin_transport", ok("origin") & (scheme("origin") != "https")),
        ("insecure_final_transport", ok("final_url") & (scheme("final_url") != "https")),
        ("unregistered_official_host", ((source != "") & ~known(source)) | ((final != "") & ~known(final))),
        ("cross_origin_redirect", ok("origin") & ok("final_url") & ((source != final) | (port("origin") != port("final_url"))) & ~pair),
        ("insecure_redirect", (scheme("origin") == "https") & (scheme("final_url") == "http")),
        ("empty_body", kind == "empty"),
        ("captcha_page", F.array_contains("blocked", "captcha")),
        ("waf_block_page", F.array_contains("blocked", "firewall")),
        ("login_page", F.array_contains("blocked", "login")),
        ("mime_magic_mismatch", ~kind.isin("empty", "unknown") & media_mismatch(kind, c("content_type"), given("final_url"), c("body"))),
        ("unsupported_media_type", ~kind.isin("empty", "html", "json", *FILES)),
        ("empty_spa_shell", (kind == "html") & html.is_empty_shell(c("r.raw"), c("r.shown"), least)),
        ("malformed_json", (kind == "json") & ~semantic),
        ("raw_render_mismatch", c("r.render_share") < 0.55),
        ("document_kind_mismatch", other_kind),
        ("expected_title_mismatch", semantic & (c("r.title_share") < 0.8)),
        ("expected_buyer_mismatch", semantic & ~F.contains("r.said", "r.buyer")),
        ("expected_project_code_mismatch", semantic & ~F.contains("r.said", "r.code")),
    )
    codes = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules)))
    found = rows.withColumn("error_codes", codes).withColumn("verdict", F.when(F.size("error_codes") > 0, "reject").otherwise("allow"))
    found = found.withColumn("raw_sha256", F.sha2(F.coalesce("body", F.lit(b"")), 256)).withColumn("analysis_sha256", F.coalesce(F.sha2("analysis_body", 256), F.lit("")))
    return found.select(*items.columns, "verdict", "error_codes", "detected_kind", "source_host", "final_host", "raw_sha256", "analysis_sha256")
