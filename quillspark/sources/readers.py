"""Recorded responses as tables: seed lists, feeds, HTML lists, files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, html, text, urls
from ..functions.patterns import one_of
from ..shipping import vectorised

# Limits that extracted texts depend on.
MOST_TEXT, MOST_ENTRIES, MOST_BYTES = 300_000, 200, 64 * 1024 * 1024
SEED_COLUMNS = ("url", "title", "published_at", "buyer", "notice_type", "source", "region", "external_id")
FEED = "code int, message string, data struct<pages:int,records:array<struct<id:string,url:string,title:string,publishTime:string,provinceText:string,cityText:string,businessTypeText:string,informationTypeText:string,transactionSourcesPlatformText:string,industryTypeText:string>>>"
NOTICE_WORDS = ("招标", "采购", "中标", "成交", "磋商", "谈判", "询价", "公告", "结果", "tender", "procurement", "bid", "award", "notice")
DETAIL_WORDS = ("detail", "article", "content", "notice")
DETAIL_FIELDS = ("项目名称", "项目编号", "采购人", "招标人", "中标供应商", "成交供应商", "开标时间")
NAVIGATION = ("首页", "上一页", "下一页", "末页", "更多", "返回", "登录", "注册", "退出", "联系我们", "网站地图", "政务公开", "信息公开")
AGGREGATES = ("首页", "网站首页", "招标中心", "采购中心", "招采中心", "公告中心", "招标频道", "采购频道", "公告频道", "搜索", "搜索结果", "查询结果", "信息公开", "文件下载", "下载中心")
LIST_ENDS = ("列表", "中心", "频道", "首页")
RESULT_ENDS = ("搜索结果", "查询结果")
CHALLENGES = ("请输入验证码", "访问验证", "人机验证", "滑动验证", "captcha", "verify you are human", "slide jigsaw to complete verification")
PERHAPS_CHALLENGES = ("安全验证", "完成验证")
PUBLISHED = ("发布时间", "发布日期", "公告日期", "中标日期", "成交日期")
NOTICE_TYPES = (("中标", "中标公告"), ("成交", "成交公告"), ("结果", "结果公告"), ("招标", "招标公告"), ("采购", "采购公告"))
OTHER_NOTICE = "自定义公告"
IDENTIFIER = r"(?i)[0-9]{5,}|[a-f0-9]{12,}"
IDENTIFIED = r"(?i)(?:^|&)(?:id|infoid|articleid|noticeid|contentid|uuid|code)=[^&\s]{3,}"
SITE_BUYER = r"(?:采购人|采购单位|招标人)\s*[:：]\s*([^\n]{2,100})"
SITE_BUYER_ENDS = r"(?s)\s{2,}.*$|地址\s*[:：].*$|联系人\s*[:：].*$"
PAGER = r"(?:共\s*([0-9]+)\s*条)|size:\s*([0-9]+)"
JSONP = "recordnum int, datas array<struct<title:string,gtitle:string,timestamp:string,pubdate:string,docpuburl:string,url:string,tType:string,iType:string,area:string,purchaser:string>>"


def seeds(spark: SparkSession, path: str, first: str, last: str, source: str = "url_seed", region: str = "吉林省", kind: str = "官方补录") -> tuple[DataFrame, DataFrame]:
    """(notices, skipped): rows of seed CSV files in the date range, with defaults filled; and (skipped) how many had no valid date."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in SEED_COLUMNS if c not in raw.columns})
    day = F.try_to_date(F.substring(F.trim("published_at"), 1, 10), "yyyy-MM-dd")
    rows = raw.withColumn("day", day)
    url = F.trim("url")
    filled = lambda c, default: F.coalesce(text.first_filled(F.col(c)), default)
    kept = rows.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.coalesce(url, F.lit("")) != ""))
    notices = kept.select(
        filled("source", F.lit(source)).alias("source"),
        filled("external_id", text.stable_id(url)).alias("external_id"),
        filled("title", url).alias("title"),
        F.date_format("day", "yyyy-MM-dd").alias("published_at"),
        url.alias("url"),
        filled("region", F.lit(region)).alias("region"),
        filled("notice_type", F.lit(kind)).alias("notice_type"),
        filled("buyer", F.lit("")).alias("buyer"),
    )
    return notices, rows.where("day is null").agg(F.count("*").alias("skipped"))


def json_of(body: Column) -> Column:
    """The JSON inside a callback, or the body itself."""
    return F.regexp_replace(F.trim(body), r"(?s)^[\w$.]+\s*\((.*)\)\s*;?\s*$", "$1")


def jsonp_list(responses: DataFrame, body: str, regions: tuple[str, ...] = (), since: str = "", strict: bool = False) -> DataFrame:
    """Records of a JSONP list; entities and tags gone, dates from messy text; of each address the first record.

    ``since`` drops older records. Broken bodies give no rows, or with ``strict`` an error, as does one without its count or list.
    """
    parsed = responses.withColumn("x", F.from_json(json_of(F.col(body)), JSONP)).withColumn("at", F.monotonically_increasing_id())
    if strict:
        whole = F.col("x.recordnum").isNotNull() & F.col("x.datas").isNotNull()
        parsed = parsed.withColumn("x", F.when(whole, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not a list of records: "), F.left(F.coalesce(F.col(body), F.lit("null")), F.lit(80)))).cast(parsed.schema["x"].dataType)))
    rows = parsed.select("at", F.posexplode("x.datas").alias("place", "r"))
    day = F.coalesce(dates.any_date(F.col("r.timestamp")), dates.any_date(F.col("r.pubdate")))
    url = text.first_filled(F.col("r.docpuburl"), F.col("r.url"))
    tidy = lambda c: F.trim(F.regexp_replace(html.unescaped(F.coalesce(F.col(c), F.lit(""))), "<[^>]*>", ""))
    rows = rows.select("at", "place", url.alias("url"), F.coalesce(text.first_filled(tidy("r.title"), tidy("r.gtitle")), F.lit("")).alias("title"), day.alias("published_at"), F.col("r.area").alias("region"), F.col("r.iType").alias("notice_type"), F.coalesce("r.purchaser", F.lit("")).alias("buyer"))
    rows = rows.where("url is not null and published_at is not null")
    rows = rows.where(F.col("published_at") >= since) if since else rows
    return first_of(rows.where(F.col("region").isin(*regions)) if regions else rows, "url", "at", "place").drop("at", "place")


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows with one key the first in order; an aggregate, so it combines before the shuffle."""
    first = rows.groupBy(F.col(key).alias("own_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("first"))
    return first.select("first.*")


def json_feed(responses: DataFrame, body: str, first: str, last: str, strict: bool = True, province: str = "") -> DataFrame:
    """Records of a JSON feed; with ``strict`` a date outside the asked range, or another province than the asked one, is an error, else such rows go."""
    rows = responses.select(F.explode(F.from_json(F.col(body), FEED)["data"]["records"]).alias("r"))
    day = dates.any_date(F.col("r.publishTime"))
    inside = F.coalesce(day.between(first, last), F.lit(False))
    rows = rows.withColumn("day", F.when(inside, day).otherwise(F.raise_error(F.concat(F.lit("date outside the range: "), F.coalesce("r.publishTime", F.lit("null")))).cast("string"))) if strict else rows.withColumn("day", day).where(inside)
    if province:
        asked = F.coalesce(F.col("r.provinceText"), F.lit("")) == province
        rows = rows.withColumn("day", F.when(asked, F.col("day")).otherwise(F.raise_error(F.concat(F.lit("another province: "), F.coalesce("r.provinceText", F.lit("null")))).cast("string"))) if strict else rows.where(asked)
    return rows.select(F.col("r.id").alias("external_id"), F.col("r.url").alias("url"), F.col("r.title").alias("title"), F.col("day").alias("published_at"), F.concat_ws("-", F.col("r.provinceText"), F.nullif(F.col("r.cityText"), F.col("r.provinceText"))).alias("region"), F.col("r.informationTypeText").alias("notice_type"), F.col("r.industryTypeText").alias("industry"))


def result_list(pages: DataFrame, page: str) -> DataFrame:
    """Entries of an HTML result list: title, address, date (the last in the entry), purchaser; entries without a link aren't any."""
    rows = pages.select(F.explode(F.regexp_extract_all(F.col(page), F.lit(r"(?is)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1))).alias("entry"))
    shown = text.collapse(F.regexp_replace("entry", "(?s)<[^>]*>", " "))
    name = F.coalesce(F.nullif(F.regexp_extract("entry", r'(?is)<a\b[^>]*\btitle="([^"]*)"', 1), F.lit("")), text.collapse(F.regexp_replace(F.regexp_extract("entry", r"(?is)<a\b[^>]*>(.*?)</a\s*>", 1), "(?s)<[^>]*>", " ")))
    rows = rows.select(F.regexp_extract("entry", r'(?is)<a\b[^>]*\bhref="([^"]*)"', 1).alias("url"), name.alias("title"), dates.last_date(shown).alias("published_at"), F.regexp_extract(shown, r"(?:采购人|采购单位)\s*[:：]\s*(.+?)(?=\s*(?:代理机构|采购代理|\||$))", 1).alias("buyer"), F.trim(F.regexp_extract(shown, r"地域\s*[:：]\s*(\S+)", 1)).alias("region"))
    return rows.where("url <> ''")


def pager(pages: DataFrame, page: str, size: int = 20) -> DataFrame:
    """pages with total (records) and n_pages as the list's own pager says, and whether that agrees with the entries shown; null where there is no pager."""
    total = F.coalesce(F.nullif(F.regexp_extract(page, PAGER, 1), F.lit("")), F.nullif(F.regexp_extract(page, PAGER, 2), F.lit(""))).try_cast("int")
    shown = F.size(F.regexp_extract_all(F.col(page), F.lit(r"(?is)(<li\b[^>]*>.*?<a\b.*?</li\s*>)"), F.lit(1)))
    rows = pages.withColumn("total", total).withColumn("n_pages", F.ceil(F.col("total") / size).cast("int"))
    return rows.withColumn("consistent", F.when(F.col("total").isNotNull(), ((F.col("total") == 0) == (shown == 0)) & (shown <= F.least(F.col("total"), F.lit(size)))))


def within_archive(entries: DataFrame, first: str, last: str, terms: tuple[str, ...] = (), day: str = "published_at", columns: tuple[str, ...] = ("title", "buyer")) -> tuple[DataFrame, DataFrame]:
    """(kept, boundary): archive entries in the date range with a term in title or purchaser, without regard to case; and (oldest, reaches): whether the archive goes back to the range's start."""
    hits = F.lit(True)
    if terms:
        hits = text.blank(F.lit("x"))
        for c in columns:
            for t in terms:
                hits = hits | F.coalesce(text.contains_text(F.col(c), t), F.lit(False))
    kept = entries.where(F.col(day).between(first, last) & hits)
    oldest = F.min(day)
    return kept, entries.agg(oldest.alias("oldest"), F.coalesce(oldest <= first, F.lit(False)).alias("reaches"))


def on_days(spark: SparkSession, path: str, first: str, last: str, day: str = "day") -> DataFrame:
    """Rows of a Parquet table partitioned by day: only the partitions in the range are listed and read."""
    return spark.read.parquet(path).where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def _has(said: Column, words: tuple[str, ...]) -> Column:
    return F.lower(said).rlike(one_of(words))


def listing_page(headings: Column, title: Column) -> Column:
    """Whether a page's first heading, or its title, is that of a list: a segment that is the name of one or ends like one, unless the first segment is that of a notice."""
    primary = text.first_filled(headings, title)
    parts = F.filter(F.transform(F.split(primary, r"\s*(?:\||[-_–—·])\s*"), lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))), lambda x: x != "")
    first = F.try_element_at(parts, F.lit(1))
    detail = _has(first, NOTICE_WORDS) & ~first.rlike(f"(?:{one_of((*LIST_ENDS, *RESULT_ENDS))})$")
    bare = F.transform(parts, lambda x: F.regexp_replace(x, r"[（(][0-9]+[）)]$", ""))
    return F.coalesce(~detail & F.exists(bare, lambda x: x.isin(*AGGREGATES) | x.rlike(f"(?:{one_of(LIST_ENDS)})$")), F.lit(False))


def challenge(title: Column, headings: Column, said: Column) -> Column:
    """Whether a page asks for a check instead of showing a notice. Words that tenders use too count only where the page hasn't the shape of a notice."""
    notice = _has(F.concat_ws("\n", title, headings, F.left(said, F.lit(5000))), NOTICE_WORDS)
    shaped = _has(said, DETAIL_FIELDS) | said.rlike(r"(?:" + one_of(PUBLISHED) + r")\s*[:：]?\s*20[0-9]{2}")
    return _has(said, CHALLENGES) | (_has(said, PERHAPS_CHALLENGES) & ~(notice & shaped))


def site_pages(pages: DataFrame, url: str, page: str, terms: tuple[str, ...] = (), last_modified: str | None = None) -> DataFrame:
    """Generic site pages with why they are rejected (empty for none), title, date with its origin, kind, purchaser and whether they are notices by their shape or a file.

    Terms must stand outside links, so that a menu on every page satisfies none. last_modified: a column with that HTTP header, for pages without a date.
    """
    rows = pages.withColumn("p", html.parsed_at(F.col(page), F.col(url)))
    p = lambda x: F.col(f"p.{x}")
    modified = F.date_format(dates.http_date(F.col(last_modified)), "yyyy-MM-dd") if last_modified else F.lit("")
    rows = rows.withColumn("found", dates.preferred(("page", F.left(dates.labelled_date(p("text"), PUBLISHED), F.lit(10))), ("page", dates.any_date(p("text"))), ("last-modified", modified)))
    hits = _has(F.concat_ws(" ", p("title"), p("headings"), p("outside")), tuple(t.lower() for t in terms)) if terms else F.lit(True)
    links, words = F.size(p("links")), F.length(p("outside"))
    files = F.filter(p("links"), lambda x: F.lower(x["url"]).rlike(r"\.(?:" + one_of(html.EXTENSIONS) + ")(?:[?#]|$)"))
    start = F.lower(F.left(p("text"), F.lit(5000)))
    direct = (F.size(files) > 0) | (_has(F.concat_ws("\n", F.lower(p("title")), start), NOTICE_WORDS) & _has(start, DETAIL_FIELDS))
    reason = (
        F.when(challenge(p("title"), p("headings"), p("text")), "challenge")
        .when(words < 20, "empty")
        .when(listing_page(p("headings"), p("title")) | ((links >= 15) & (words < 10 * links)), "listing")
        .when(~hits, "no_term")
        .when(F.col("found.date") == "", "no_date")
        .otherwise("")
    )
    name = F.left(F.coalesce(text.first_filled(p("headings"), p("title")), F.lit(OTHER_NOTICE)), F.lit(300))
    rows = rows.withColumns({"name": name, "sample": F.concat_ws("\n", name, F.left(p("text"), F.lit(1000)))})
    kind = F.lit(OTHER_NOTICE)
    for word, said in reversed(NOTICE_TYPES):
        kind = F.when(F.contains("sample", F.lit(word)), said).otherwise(kind)
    raw = F.regexp_replace(html.unescaped(F.regexp_extract(p("text"), SITE_BUYER, 1)), "<[^>]*>|<.*$", " ")
    buyer = F.trim(F.regexp_replace(F.regexp_replace(raw, SITE_BUYER_ENDS, ""), r"\s+", " "))
    return rows.select(F.col(url).alias("url"), F.col("name").alias("title"), F.col("found.date").alias("published_at"), F.col("found.source").alias("date_source"), kind.alias("notice_type"), buyer.alias("buyer"), direct.alias("direct"), reason.alias("rejected"))


def detail_links(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(page_url, target, label): links of a listing to details of the same site, each address once.

    A link is to a detail if its address says so or has an identifier; one without such a word needs a label of four characters, and words of notices
    in it or on the page. Navigation, files and the page itself don't count.
    """
    rows = pages.select(F.col(url).alias("page_url"), html.parsed(F.col(page)).alias("p"))
    context = listing_page(F.col("p.headings"), F.col("p.title")) | _has(F.concat_ws("\n", "p.title", F.left("p.text", F.lit(1000))), NOTICE_WORDS)
    rows = rows.withColumn("context", context).select("page_url", "context", F.posexplode("p.links").alias("place", "link")).where("link.origin = 'link'")
    label = F.trim(F.regexp_replace(html.unescaped(F.col("link.label")), r"\s+", " "))
    rows = rows.select("page_url", "context", "place", label.alias("label"), F.explode(F.slice(html.resolved_targets(F.col("page_url"), F.col("link.url")), 1, 1)).alias("target"))
    origin = r"^(https?://[^/?#]+)"
    same = (F.regexp_extract("target", origin, 1) == F.regexp_extract("page_url", origin, 1)) & (F.col("target") != F.regexp_replace("page_url", "#.*$", ""))
    sample = F.lower(F.concat_ws(" ", urls.path(F.col("target")), urls.query(F.col("target"))))
    word, number = _has(sample, DETAIL_WORDS), sample.rlike(IDENTIFIER) | urls.query(F.col("target")).rlike(IDENTIFIED)
    fits = (word | number) & (word | _has(F.col("label"), NOTICE_WORDS) | F.col("context")) & (word | (F.length("label") >= 4))
    plain = (F.col("label") != "") & ~F.col("label").isin(*NAVIGATION) & (F.length("label") <= 300) & ~F.lower(urls.path(F.col("target"))).rlike(r"\.(?:" + one_of(html.EXTENSIONS) + ")$") & ~F.contains(urls.authority(F.col("target")), F.lit("@"))
    kept = rows.where(same & fits & plain).withColumn("key", F.concat_ws(" ", "page_url", urls.canonical_key(F.col("target"))))
    return first_of(kept, "key", "place").select("page_url", "target", "label")


def recall(baseline: DataFrame, broad: DataFrame, identity: str, most: int, *order: str) -> DataFrame:
    """Rows of the baseline scan, then up to ``most`` of the broad one that it hasn't, with their origin and whether the broad scan was cut."""
    order = order or (identity,)
    extra = first_of(broad, identity, *order).join(baseline.select(identity), identity, "left_anti")
    rest = extra.orderBy(*order).limit(most).withColumn("recall_origin", F.lit("broad"))
    more = extra.agg((F.count("*") > most).alias("truncated"))
    return first_of(baseline, identity, *order).withColumn("recall_origin", F.lit("baseline")).unionByName(rest).crossJoin(F.broadcast(more))  # one row


def _xml_words(data: bytes) -> str:
    try:
        return " ".join(x.text for x in ElementTree.fromstring(data).iter() if x.text and x.text.strip())
    except ElementTree.ParseError:
        return ""


def file_text(name: str, body: bytes) -> tuple[str, bool, str]:
    """(text, needs review, why) of one file by its suffix."""
    suffix = ("." + name.rsplit(".", 1)[-1].lower()) if "." in name else ""
    if suffix in (".html", ".htm"):
        return html.parse(html.decoded(body))["text"][:MOST_TEXT], False, ""
    if suffix in (".txt", ".json", ".xml", ".csv"):
        return body.decode("utf-8", "replace")[:MOST_TEXT], False, ""
    if suffix in (".docx", ".xlsx", ".zip"):
        office = suffix != ".zip"
        out, total, unread = [], 0, 0
        try:
            with zipfile.ZipFile(io.BytesIO(body)) as archive:
                entries = [x for x in archive.infolist() if not x.is_dir()]
                if len(entries) > MOST_ENTRIES:
                    return "", True, "too many entries"
                for entry in entries:
                    total += entry.file_size
                    if total > MOST_BYTES:
                        return "\n".join(out)[:MOST_TEXT], True, "too large when unpacked"
                    inner = entry.filename.lower()
                    if office:
                        if inner.endswith(".xml") and inner.startswith(("word/", "xl/sharedstrings", "xl/worksheets")):
                            out.append(_xml_words(archive.read(entry)))
                    elif inner.endswith((".txt", ".html", ".htm", ".xml", ".json")):
                        raw = archive.read(entry)
                        out.append(html.parse(html.decoded(raw))["text"] if inner.endswith((".html", ".htm")) else raw.decode("utf-8", "replace"))
                    else:
                        unread += 1
        except (zipfile.BadZipFile, OSError, RuntimeError) as error:
            return "", True, f"broken archive: {type(error).__name__}"
        joined = re.sub(r"\s+", " ", " ".join(out)).strip() if office else "\n".join(out)
        return joined[:MOST_TEXT], not joined or unread > 0, f"{unread} entries not read" if unread else "" if joined else "no text"
    if suffix == ".pdf":
        return "", True, "no reader for PDF here"
    return "", True, f"no reader for {suffix or 'files without a suffix'}"


@vectorised("text string, needs_review boolean, reason string")
def file_texts(name: pd.Series, body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([file_text(n or "", bytes(b) if b is not None else b"") for n, b in zip(name, body, strict=True)], columns=["text", "needs_review", "reason"])


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, text, needs_review, reason) of the files under a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), file_texts("path", "content").alias("f")).select("path", "length", "sha256", "f.*")
