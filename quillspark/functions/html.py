"""HTML: native patterns for what they can express, an Arrow function with a tolerant parser for the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import parse_qsl, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import in_parts, vectorised, vectorised_in_parts

# What makes a link an attachment, and what makes a page one that blocks.
EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "zip", "rar", "7z", "ofd", "txt")
URL_TOKENS = ("download", "attachment", "filedown")
LABEL_TOKENS = ("附件", "下载", "采购文件", "招标文件")
PLACEHOLDERS = ("附件下载", "点击下载", "点击此处下载", "下载附件", "下载", "点击查看", "查看附件")
CAPTCHA = (r"请输入.{0,8}验证码", r"请完成.{0,8}(?:安全)?验证", r"(?:访问|安全|人机|滑块)验证", r"验证码.{0,12}(?:错误|过期|刷新|输入)", r"(?:captcha|geetest|hcaptcha|recaptcha)(?:[\s_./?'\"=-]|$)", r"challenge-platform", r"aliyun.*captcha")
FIREWALL = (r"waf[\s_-]*challenge", r"cloudflare\s+ray\s+id", r"cf-chl-", r"access\s+denied", r"request\s+blocked", r"访问过于频繁", r"请求过于频繁", r"您的访问已被拦截", r"异常访问")
LOGIN = (r"<input[^>]+type\s*=\s*['\"]?password", r"登录后(?:查看|下载|访问|获取)", r"请先登录", r"账号密码登录", r"<title[^>]*>\s*(?:用户)?登录\s*</title>")
REDIRECT_KEYS = ("url", "target", "targeturl", "target_url", "redirect", "redirecturl", "redirect_url", "jump", "jumpurl", "jump_url", "sourceurl", "source_url", "originalurl", "original_url")

DATA_ATTRIBUTES = ("data-url", "data-href", "data-download-url", "data-target", "data-source-url", "data-original-url")
CALLED = r"['\"]((?:https?:)?//[^'\"]+|/[^'\"]+|[^'\"]+(?:\.pdf|\.docx?|\.xlsx?|\.zip|download|filedown)[^'\"]*)['\"]"
FILE_NAME = r"\.(?:pdf|docx?|xlsx?|zip|rar|7z|ofd|txt)(?:\b|\s|[（(])"
FILE_ROUTE = r"(?:^|[/_.-])(?:download(?:file)?|attachment|filedown|getfile|files?|documents?)(?:$|[/_.-])"
FILE_KEYS = ("id", "uuid", "guid", "token", "key", "code", "f", "url", "path", "name", "filename")
FILE_KEY_PARTS = ("file", "attachment", "document", "download")
#: Hosts and paths whose pages have their text in one element of a class.
ARTICLES = {("www.jl.gov.cn", "/ggzy/"): "ewb-article", ("jl.gov.cn", "/ggzy/"): "ewb-article"}
SHELL_MARKS = (r"<script\b", r"<(?:div|main)[^>]+id\s*=\s*['\"](?:app|root|__next|rootapp)['\"]")

TITLE_PATTERN = "(?is)<title[^>]*>(.*?)</title>"
LINK_PATTERN = '(?i)<a[^>]*href="([^"]*)"[^>]*>'
#: The mark of an entity that no semicolon ends, &amp excepted.
UNCLOSED = r"&(?!amp)(?=(?:[A-Za-z][A-Za-z0-9]*+|#[0-9]++|#[xX][0-9A-Fa-f]++)(?!;))"


def title(page: Column) -> Column:
    """The text of the first title element, blanks collapsed, entities as they are."""
    return F.trim(F.regexp_replace(F.regexp_extract(page, TITLE_PATTERN, 1), r"\s+", " "))


def link_targets(page: Column) -> Column:
    """href of every anchor that has it in double quotes, in order, as written."""
    return F.regexp_extract_all(page, F.lit(LINK_PATTERN), F.lit(1))


def unclosed_as_written(page: Column) -> Column:
    """The page, changed so that a parser shows entities that no semicolon ends, as where a title was cut, as they stand; &amp is read all the same.

    HTML has parsers read some of them (&quot, &lt), and parse() does.
    """
    return F.regexp_replace(page, UNCLOSED, "&amp;")


def looks_like_attachment(url: Column, label: Column) -> Column:
    """By the path's extension, a token in the URL, a token or a file name in the label."""
    extension = r"(?i)^[^?#]*\.(?:" + "|".join(EXTENSIONS) + r")(?:[?#]|$)"
    named = r"(?i)\.(?:pdf|docx?|xlsx?|zip|rar|7z|ofd|txt)(?:[^a-z0-9]|$)"
    return url.rlike(extension) | F.lower(url).rlike("|".join(URL_TOKENS)) | F.coalesce(label, F.lit("")).rlike("|".join(LABEL_TOKENS)) | F.coalesce(label, F.lit("")).rlike(named)


def attachment_error(url: Column) -> Column:
    """placeholder, scheme or empty for none: button captions that ended up as addresses, and addresses that aren't of the web."""
    last = F.trim(F.regexp_extract(F.coalesce(F.try_url_decode(F.regexp_replace(url, "[?#].*$", "")), url), "([^/]*)/*$", 1))
    kind = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.when(last.isin(*PLACEHOLDERS), "placeholder").when((kind != "") & ~kind.isin("http", "https"), "scheme").otherwise("")


def block_kinds(page: Column) -> Column:
    """Which of captcha, firewall and login the page shows."""
    low = F.lower(F.coalesce(page, F.lit("")))
    one = lambda patterns: F.lit("(?s)" + "|".join(f"(?:{p})" for p in patterns))  # noqa: E731  a literal is compiled once
    kinds = [F.when(F.rlike(low, one(patterns)), F.lit(name)) for name, patterns in (("captcha", CAPTCHA), ("firewall", FIREWALL), ("login", LOGIN))]
    return F.array_compact(F.array(*kinds))


def is_empty_shell(page: Column, visible: Column, least: int = 80) -> Column:
    """A page with hardly any text of its own, but with scripts or a place to mount an application."""
    n = F.length(F.regexp_replace(visible, r"[^\p{L}\p{N}]", ""))
    low = F.lower(page)
    return (n < least) & ((n < 20) | F.rlike(low, F.lit(SHELL_MARKS[0])) | F.rlike(low, F.lit(SHELL_MARKS[1])))


class _Page(HTMLParser):
    """Collects text, links with labels, embedded addresses, and where text stands."""

    SKIP = {"script", "style", "noscript", "template"}
    LINES = {"p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "dt", "dd"}

    def __init__(self, article: str = "") -> None:
        """article: the class of the one element that counts, if only that does."""
        super().__init__(convert_charrefs=True)
        self.article, self.depth, self.found = article, 0 if article else 1, False
        self.skip, self.text, self.title, self.headings, self.outside = 0, [""], [], [], []
        self.links: list[tuple[str, str, str]] = []
        self.rows: list[dict] = []
        self.row: list[dict] = []
        self.anchor: tuple[str, list[str]] | None = None
        self.within: list[str] = []

    def handle_starttag(self, tag, attrs):
        have = {k: v or "" for k, v in attrs}
        if self.article and tag == "div":
            if self.depth or (not self.found and self.article in have.get("class", "").split()):
                self.depth, self.found = self.depth + 1, True
        if not self.depth:
            return
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.LINES:
            self.text.append("")
        if tag in ("title", "h1", "h2"):
            self.within.append(tag)
        if tag in ("tr", "li"):
            self.row.append({"text": [], "links": []})
        extra = [have[k] for k in DATA_ATTRIBUTES if have.get(k)]
        if tag in ("iframe", "embed", "object"):
            extra += [x for x in (have.get("src") or have.get("data") or have.get("data-src"),) if x]
        called = re.search(CALLED, have.get("onclick", ""), re.I)
        extra += [called[1]] if called else []
        label = (have.get("aria-label") or have.get("title") or have.get("value") or "").strip()
        if tag == "a":
            self.close_anchor()
            self.anchor = (have.get("href", "").strip(), [])
        self.links += [(x.strip(), label, "attribute") for x in extra]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def close_anchor(self):
        if self.anchor and self.anchor[0]:
            found = (self.anchor[0], " ".join(self.anchor[1]), "link")
            self.links.append(found)
            if self.row:
                self.row[-1]["links"].append(found[:2])
        self.anchor = None

    def handle_endtag(self, tag):
        if not self.depth:
            return
        self.depth -= bool(self.article and tag == "div")
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if tag in self.LINES:
            self.text.append("")
        if tag == "a":
            self.close_anchor()
        if tag in ("tr", "li") and self.row:
            self.rows.append(self.row.pop())
        if self.within and self.within[-1] == tag:
            self.within.pop()

    def handle_data(self, data):
        if not self.depth:
            return
        for found in re.findall(r"(?:https?:)?//[^\s<>\"'`\\]+", data):
            self.links.append((found.rstrip(".,;:!?，。；：！？、)]}）】》>"), "", "text"))
        if self.skip:
            return
        tidy = " ".join(data.split())
        if not tidy:
            return
        if "title" in self.within:
            self.title.append(tidy)
            return
        if self.within:
            self.headings.append(tidy)
        self.text[-1] = f"{self.text[-1]} {tidy}".strip()
        if self.row:
            self.row[-1]["text"].append(tidy)
        if self.anchor:
            self.anchor[1].append(tidy)
        else:
            self.outside.append(tidy)


def _fed(page: str, article: str = "") -> _Page:
    parser = _Page(article)
    parser.feed(page)
    parser.close()
    parser.close_anchor()
    return parser


def article_of(url: str) -> str:
    """The class of the element that has a page's text, if its host is one where only that counts."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return ""
    return next((name for (host, start), name in ARTICLES.items() if parts.hostname == host and parts.path.startswith(start)), "")


def parse(page: str | None, url: str = "") -> dict:
    """text, title, headings, text outside links, links (url, label, origin) and rows (text, links) of one page; of its article alone where the address says so and there is one."""
    article = article_of(url) if url else ""
    parser = _fed(page or "", article)
    if article and not parser.found:
        parser = _fed(page or "")
    rows = [{"text": " ".join(r["text"]), "links": [{"url": u, "label": v} for u, v in r["links"]]} for r in parser.rows]
    return {"text": "\n".join(x for x in parser.text if x), "title": " ".join(parser.title), "headings": " ".join(parser.headings), "outside": " ".join(parser.outside), "links": [{"url": u, "label": v, "origin": o} for u, v, o in parser.links], "rows": rows}


PARSED = "text string, title string, headings string, outside string, links array<struct<url:string,label:string,origin:string>>, rows array<struct<text:string,links:array<struct<url:string,label:string>>>>"


@vectorised_in_parts(PARSED)
def parsed(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Column of pages -> struct with what parse() gives."""
    names = [x.split()[0] for x in PARSED.split(", ")]
    for batch in in_parts(pages):
        yield pd.DataFrame([parse(x) for x in batch], columns=names)


@vectorised_in_parts(PARSED)
def parsed_at(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Columns of pages and their addresses -> struct with what parse() gives."""
    names = [x.split()[0] for x in PARSED.split(", ")]
    for pages, url in in_parts(batches):
        yield pd.DataFrame([parse(x, u or "") for x, u in zip(pages, url, strict=True)], columns=names)


def strong_attachment(url: Column, label: Column) -> Column:
    """Whether a link is to a file for certain: by extension, by a file name in its label, or by a file route together with what identifies a file.

    A caption alone doesn't: many sites have a link to "downloads" on every page.
    """
    path = F.lower(F.coalesce(F.try_url_decode(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)), F.lit("")))
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    named = path.rlike(r"\.(?:" + "|".join(EXTENSIONS) + ")$") | F.lower(F.coalesce(label, F.lit(""))).rlike(FILE_NAME)
    value = lambda x: F.trim(F.coalesce(F.try_url_decode(F.regexp_replace(x, "^[^=]*=?", "")), F.lit("")))
    key = lambda x: F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(F.substring_index(x, "=", 1)), F.lit(""))), "[^a-z0-9]", "")
    identity = lambda x: (value(x) != "") & (key(x).isin(*FILE_KEYS) | key(x).rlike("|".join(FILE_KEY_PARTS)) | value(x).rlike(r"(?i)^(?=.*[a-z])(?=.*[0-9]).{12,}$"))
    rest = F.substring_index(F.regexp_replace(F.regexp_replace(path, r"(?s)^.*?" + FILE_ROUTE, ""), "^[/_.-]+", ""), "/", 1)
    own = rest.rlike("^[0-9]+$|^[a-f0-9-]{12,}$") | ((F.length(rest) >= 6) & rest.rlike("[a-z]") & rest.rlike("[0-9]"))
    by_route = path.rlike(FILE_ROUTE) & (F.exists(F.split(asked, "&"), identity) | asked.rlike("(?i)^[a-z0-9_-]{4,}$") | own)
    return F.coalesce(named | by_route, F.lit(False))


@vectorised("string")
def unescaped(value: pd.Series) -> pd.Series:
    """Entities as the characters that they stand for."""
    return pd.Series([None if x is None else unescape(x) for x in value])


def resolved(base: str, url: str) -> list[str]:
    """The absolute form of a link and the targets that its query hands on, each decoded up to twice."""
    try:
        out = [urljoin(base, unescape(url))]
        for key, value in parse_qsl(urlsplit(out[0]).query):
            if key.lower() in REDIRECT_KEYS:
                out += [x for x in dict.fromkeys((value, unquote(value))) if x.lower().startswith(("http://", "https://"))]
    except ValueError:
        return []
    return list(dict.fromkeys(x.partition("#")[0] for x in out))


@vectorised_in_parts("array<struct<url:string,label:string,origin:string,targets:array<string>>>")
def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Columns of addresses and their pages -> the pages' links alone, each with what resolved() gives for it."""
    for base, pages in in_parts(batches):
        yield pd.Series([[{"url": u, "label": v, "origin": o, "targets": resolved(b or "", u)} for u, v, o in _fed(x or "").links] for b, x in zip(base, pages, strict=True)], dtype=object)


@vectorised("array<string>")
def resolved_targets(base: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([resolved(b or "", u or "") for b, u in zip(base, url, strict=True)])


def decoded(body: bytes, content_type: str = "") -> str:
    """By the declared charset, else UTF-8, else GB 18030, else UTF-8 with replacements."""
    named = re.search(r"charset\s*=\s*['\"]?([\w.-]+)", content_type or "", re.I)
    for charset in [*([named[1]] if named else []), "utf-8-sig", "gb18030"]:
        try:
            return body.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("utf-8", "replace")
