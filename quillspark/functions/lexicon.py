"""Relevance by terms: candidates, industry, categories, rule decision, guards, and the fold of criteria reviews."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import vectorised
from . import terms
from .patterns import one_of

# Terms, industries and categories that results depend on.
STRONG_TERMS = (
    "网络安全", "信息安全", "数据安全", "等级保护", "等保测评", "等保整改",
    "密码应用安全性评估", "密评", "商用密码", "漏洞扫描", "渗透测试", "攻防演练",
    "应急响应", "安全运维", "安全运营", "防火墙", "入侵检测", "入侵防御",
    "堡垒机", "网闸", "日志审计", "数据库审计", "态势感知", "零信任",
    "终端检测与响应", "终端安全", "身份认证", "抗ddos", "抗拒绝服务",
    "waf", "edr", "soc", "siem", "dlp", "ips", "ids",
)
BROAD_TERMS = ("信息化", "网络", "系统", "平台", "运维", "软件", "数据中心", "云平台", "机房", "国产化", "信创", "密码", "安全设备", "安全服务")
NEGATIVE_TERMS = ("消防安全", "生产安全", "食品安全", "交通安全", "施工安全", "安全生产责任")
OTHER_INDUSTRY = "其他行业"
INDUSTRY_RULES = (
    ("教育", ("大学", "学院", "学校", "中学", "小学", "教育局", "幼儿园")),
    ("医疗卫生", ("医院", "卫生院", "卫生健康", "疾控", "医疗保障", "血站", "医共体")),
    ("政法公安", ("公安", "法院", "检察院", "司法局", "监狱", "交警")),
    ("交通物流", ("交通运输", "公路", "铁路", "机场", "港口", "物流")),
    ("能源电力", ("电力", "供电", "能源", "燃气", "煤矿", "石油")),
    ("通信广电", ("通信", "移动", "联通", "电信", "广播电视")),
    ("金融", ("银行", "证券", "保险", "金融")),
    ("科研", ("研究院", "研究所", "实验室", "科技馆")),
    ("文旅", ("文化和旅游", "博物馆", "图书馆", "景区")),
    ("公共事业", ("水务", "供水", "供热", "环境", "市政")),
    ("党政", ("人民政府", "委员会", "管理局", "财政局", "税务局", "机关事务")),
)
OTHER_CATEGORY = "其他网络安全"
FOCUS_MARK = "\n---证据片段---\n"
CATEGORY_RULES = (
    ("安全设备", ("防火墙", "waf", "ips", "ids", "网闸", "堡垒机", "审计设备")),
    ("终端与身份", ("edr", "终端安全", "身份认证", "零信任", "终端准入")),
    ("数据与密码", ("数据安全", "dlp", "数据库审计", "商用密码", "密评", "国密")),
    ("应用与云安全", ("应用安全", "代码审计", "api安全", "云安全", "容器安全")),
    ("安全运营与运维", ("安全运维", "安全运营", "网络安全设备维保", "安全设备维保", "soc", "siem", "应急响应", "攻防演练")),
    ("测评咨询", ("等保", "等级保护", "风险评估", "渗透测试", "漏洞扫描", "认证服务")),
    ("安全集成与软件", ("安全集成", "安全软件", "安全平台", "态势感知")),
)


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms, in their order, that are substrings of the text in lower case; no word boundaries."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(x.lower())), F.lit(x)) for x in terms)))


def has_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether the text has one of the terms: one pass over it, by alternation."""
    if not terms:
        return F.lit(False)
    return F.lower(F.coalesce(text, F.lit(""))).rlike(one_of([x.lower() for x in terms]))


def is_candidate(text: Column, strong: Sequence[str] = STRONG_TERMS, broad: Sequence[str] = BROAD_TERMS) -> Column:
    return has_any(text, (*strong, *broad))


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The name of the first rule with a term in the text."""
    out = F.lit(default)
    for name, terms in reversed(rules):
        out = F.when(text.rlike(one_of(terms)), F.lit(name)).otherwise(out)
    return out


def all_rules(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The names of all rules with a term in the text, in their order; the default alone if there is none."""
    names = F.array_compact(F.array(*(F.when(has_any(text, terms), F.lit(name)) for name, terms in rules)))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


def industry(buyer: Column, title: Column, rules=INDUSTRY_RULES, default: str = OTHER_INDUSTRY) -> Column:
    """By the buyer's name first, then by what the title says after the word for "about"."""
    by_buyer = first_rule(F.coalesce(buyer, F.lit("")), rules, default)
    return F.when(by_buyer != default, by_buyer).otherwise(first_rule(F.regexp_replace(F.coalesce(title, F.lit("")), "(?s)^.*?关于", ""), rules, default))


def rule_decision(text: Column, strong: Sequence[str] = STRONG_TERMS, broad: Sequence[str] = BROAD_TERMS, negative: Sequence[str] = NEGATIVE_TERMS) -> Column:
    """(relevant, confidence, evidence, needs_review, ai_confirmed): relevant is true, false or null; rules alone never confirm."""
    hits, against = found_terms(text, strong), found_terms(text, negative)
    yes = (F.size(hits) > 0) & ~((F.size(against) > 0) & (F.size(hits) == 1))
    perhaps = is_candidate(text, strong, broad)
    return F.struct(
        F.when(yes, F.lit(True)).when(perhaps, F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("relevant"),
        F.when(yes, F.lit(0.65)).when(perhaps, F.lit(0.45)).otherwise(F.lit(0.70)).alias("confidence"),
        F.slice(hits, 1, 5).alias("evidence"),
        F.lit(True).alias("needs_review"),
        F.lit(False).alias("ai_confirmed"),
    )


def lexicon_of(strong: Sequence[str] = STRONG_TERMS, broad: Sequence[str] = BROAD_TERMS, negative: Sequence[str] = NEGATIVE_TERMS) -> terms.Dictionary:
    """The terms of a rule decision as one dictionary, for any number of terms."""
    return terms.Dictionary.rules((("strong", strong), ("broad", broad), ("negative", negative)))


def rule_decision_of(hits: Column, strong: Sequence[str] = STRONG_TERMS) -> Column:
    """What rule_decision() gives, from the hits of lexicon_of() in the lower-cased text: one pass over it for all terms."""
    found = terms.terms_of(hits, "strong")
    spelled = F.create_map(*(F.lit(x) for t in strong for x in (t.lower(), t))) if strong else F.create_map().cast("map<string,string>")
    against, perhaps = F.size(terms.terms_of(hits, "negative")) > 0, F.size(terms.names(hits)) > 0
    yes = (F.size(found) > 0) & ~(against & (F.size(found) == 1))
    maybe = perhaps & F.exists(terms.names(hits), lambda n: n != "negative")
    return F.struct(
        F.when(yes, F.lit(True)).when(maybe, F.lit(None).cast("boolean")).otherwise(F.lit(False)).alias("relevant"),
        F.when(yes, F.lit(0.65)).when(maybe, F.lit(0.45)).otherwise(F.lit(0.70)).alias("confidence"),
        F.transform(F.slice(found, 1, 5), lambda t: spelled[t]).alias("evidence"),
        F.lit(True).alias("needs_review"),
        F.lit(False).alias("ai_confirmed"),
    )


def decision_and_rules(text: Column, rules: Sequence[tuple[str, Sequence[str]]], strong: Sequence[str] = STRONG_TERMS, broad: Sequence[str] = BROAD_TERMS, negative: Sequence[str] = NEGATIVE_TERMS) -> tuple[Column, Callable, Callable]:
    """(hits, verdict, names): the hits of all terms of a rule decision and of rules in one pass over a text, and two functions of the column that keeps these: what rule_decision() gives, and what all_rules() gives with a default."""
    spoken = ("strong", "broad", "negative")
    prefix = "rule:"  # so that a rule may be named like one of them
    entries = ((spoken[0], strong), (spoken[1], broad), (spoken[2], negative), *((prefix + name, of) for name, of in rules))
    hits = terms.Dictionary.rules(entries).hits(F.lower(F.coalesce(text, F.lit(""))))
    verdict = lambda found: rule_decision_of(F.filter(found, lambda h: h["name"].isin(*spoken)), strong)

    def names(found: Column, default: str) -> Column:
        own = F.transform(F.filter(terms.names(found), lambda n: n.startswith(prefix)), lambda n: F.substring(n, len(prefix) + 1, 1 << 30))
        return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(default)))

    return hits, verdict, names


def guarded(verdict: Column, text: Column, accept: float = 0.85, strong: Sequence[str] = STRONG_TERMS) -> Column:
    """A verdict (relevant, confidence, evidence, needs_review, ai_confirmed) sent to review where it isn't backed.

    A yes needs a strong term in its evidence; a no needs a text without one, and enough confidence.
    """
    quoted = F.array_join(F.coalesce(verdict["evidence"], F.array().cast("array<string>")), "\n")
    weak = (F.coalesce(verdict["relevant"], F.lit(False)) & ~has_any(quoted, strong)) | (~F.coalesce(verdict["relevant"], F.lit(True)) & (has_any(text, strong) | (verdict["confidence"] < accept)))
    forced = F.struct(F.lit(None).cast("boolean").alias("relevant"), F.least(verdict["confidence"], F.lit(0.5)).alias("confidence"), verdict["evidence"].alias("evidence"), F.lit(True).alias("needs_review"), F.lit(False).alias("ai_confirmed"))
    return F.when(weak, forced).otherwise(F.struct(*(verdict[c].alias(c) for c in ("relevant", "confidence", "evidence", "needs_review", "ai_confirmed"))))


def agreed(first: Column, second: Column, strong: Sequence[str] = STRONG_TERMS) -> Column:
    """Two guarded verdicts as one: both a backed and confirmed yes give the second with the smaller confidence; else the second, for review where they differ."""
    backed = lambda v: F.coalesce(v["relevant"], F.lit(False)) & v["ai_confirmed"] & has_any(F.array_join(v["evidence"], "\n"), strong)
    yes_both = F.coalesce(first["relevant"] & second["relevant"], F.lit(False))
    build = lambda v, conf, review: F.struct(F.when(review, F.lit(None).cast("boolean")).otherwise(v["relevant"]).alias("relevant"), conf.alias("confidence"), v["evidence"].alias("evidence"), (review | v["needs_review"]).alias("needs_review"), (v["ai_confirmed"] & ~review).alias("ai_confirmed"))
    return (
        F.when(backed(first) & backed(second), build(second, F.least(first["confidence"], second["confidence"]), F.lit(False)))
        .when(~first["relevant"].eqNullSafe(second["relevant"]) | yes_both, build(second, F.least(second["confidence"], F.lit(0.5)), F.lit(True)))
        .otherwise(build(second, second["confidence"], F.lit(False)))
    )


def decision(verdict: Column, accept: float = 0.85, strong: Sequence[str] = STRONG_TERMS) -> Column:
    """metadata_ready, excluded or review."""
    sure = F.coalesce(verdict["relevant"], F.lit(False)) & verdict["ai_confirmed"] & ~verdict["needs_review"] & (verdict["confidence"] >= accept)
    return (
        F.when(sure & has_any(F.array_join(verdict["evidence"], "\n"), strong), "metadata_ready")
        .when(~F.coalesce(verdict["relevant"], F.lit(True)) & ~verdict["needs_review"], "excluded")
        .otherwise("review")
    )


def folded_review(checks: Column, text: Column, truncated: Column, least: float = 0.9) -> Column:
    """match, suspect or no_match from criteria (map of struct verdict, confidence, evidence).

    A verdict counts only with enough confidence and a quotation of 2 to 300 characters that stands in the text. One
    no_match decides, else one unknown makes a suspect; a cut text can't prove a no_match.
    """
    quoted = lambda v: F.exists(F.coalesce(v["evidence"], F.array().cast("array<string>")), lambda q: F.length(q).between(2, 300) & F.contains(text, q))
    firm = F.transform(F.map_values(checks), lambda v: F.when((v["confidence"] >= least) & quoted(v), v["verdict"]).otherwise("unknown"))
    status = F.when(F.array_contains(firm, "no_match"), "no_match").when(F.array_contains(firm, "unknown"), "suspect").otherwise("match")
    return F.when(truncated & (status == "no_match"), "suspect").otherwise(status)


INDUSTRIES = (*(name for name, _ in INDUSTRY_RULES), OTHER_INDUSTRY)
CATEGORIES = (*(name for name, _ in CATEGORY_RULES), OTHER_CATEGORY)


def parsed_verdict(raw: Column, text: Column, strong: Sequence[str] = STRONG_TERMS, title: Column | None = None, buyer: Column | None = None) -> Column:
    """A recorded model answer as a verdict, checked: booleans must be booleans, evidence must be quoted word for word, a yes needs a strong term in it.

    The industry is that of the rules by purchaser and title, if they know one, else the answer's, if it is one of INDUSTRIES; categories are the answer's
    that are in CATEGORIES, or those of the rules. Quotations of 2 to 200 characters count, five at most. A broken answer gives a null verdict that needs review.
    """
    shape = "relevant boolean, confidence double, evidence array<string>, industry string, security_categories array<string>, reason string, needs_review boolean"
    item, empty = F.from_json(raw, shape), F.array().cast("array<string>")
    title, buyer = title if title is not None else F.lit(""), buyer if buyer is not None else F.lit("")
    whole = F.concat_ws("\n", title, buyer, text)
    said = F.slice(F.filter(F.transform(F.coalesce(item["evidence"], empty), lambda q: F.trim(q)), lambda q: F.length(q).between(2, 200)), 1, 5)
    quoted = F.filter(said, lambda q: F.contains(whole, q))
    fine = item.isNotNull() & F.get_json_object(raw, "$.confidence").isNotNull() & F.array_contains(F.json_object_keys(raw), "relevant")
    unbacked = F.coalesce(item["relevant"], F.lit(False)) & ~F.exists(quoted, lambda q: has_any(q, strong))
    confidence = F.least(F.greatest(F.coalesce(item["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    firm = fine & ~unbacked & item["relevant"].isNotNull()
    by_rule = industry(buyer, title)
    named = F.when(by_rule != OTHER_INDUSTRY, by_rule).when(item["industry"].isin(*INDUSTRIES), item["industry"]).otherwise(OTHER_INDUSTRY)
    known = F.filter(F.coalesce(item["security_categories"], empty), lambda x: x.isin(*CATEGORIES))
    categories = F.when((F.size(known) == 0) | (known == F.array(F.lit(OTHER_CATEGORY))), all_rules(whole, CATEGORY_RULES, OTHER_CATEGORY)).otherwise(known)
    return F.struct(
        F.when(firm, item["relevant"]).alias("relevant"),
        F.when(firm, confidence).otherwise(F.least(confidence, F.lit(0.5))).alias("confidence"),
        quoted.alias("evidence"),
        (~firm | F.coalesce(item["needs_review"], F.lit(False))).alias("needs_review"),
        F.coalesce(firm & item["relevant"], F.lit(False)).alias("ai_confirmed"),
        named.alias("industry"),
        categories.alias("categories"),
        F.left(F.coalesce(item["reason"], F.lit("")), F.lit(500)).alias("reason"),
    )


def focused(text: str, terms: Sequence[str] = (*STRONG_TERMS, *BROAD_TERMS), most: int = 50_000, windows: int = 30) -> str:
    """A long text cut down for a reader: its first fifth of ``most``, then windows around the terms in their order, until either limit is reached."""
    if len(text) <= most:
        return text
    parts, length, low = [text[: most // 5]], most // 5, text.lower()
    for term in terms:
        at = low.find(term.lower())
        while at >= 0 and length < most:
            parts.append(text[max(0, at - 600) : at + 1400])
            length += len(parts[-1]) + 1
            if len(parts) >= windows:
                break
            at = low.find(term.lower(), at + len(term))
    return FOCUS_MARK.join(parts)[:most]


@vectorised("string")
def focused_text(text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else focused(x) for x in text])
