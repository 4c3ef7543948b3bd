"""From lead pages to official sources: candidates, their kinds, the one that passes, rows of group pages."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gate, html, urls
from ..shipping import in_parts, vectorised_in_parts

# Kinds of candidates, what exports look like, what divides titles, and how long a title's key must be.
#: Kinds of candidates, in the order in which they are tried.
KINDS = ("intention_project", "intention_group", "official_notice", "official_attachment")
EXPORT_LABEL = r"(?i)(?:导出|生成|转为|另存为|保存为)\s*(?:word|pdf|docx?|\.docx?|\.pdf)"
EXPORT_URL = r"(?i)(?:^|[/_.?&=\-])(?:export|exportword|exportpdf|makepdf|topdf|toword)(?:$|[/_.?&=\-])"

TITLE_BOUNDARY = r"[-—–－|｜]+"
LEAST_KEY = 4


def is_export(url: Column, label: Column, lead: Column) -> Column:
    """A lead site's own conversion of a page: no original."""
    own = (urls.host(url) == urls.host(lead)) & F.concat(urls.path(url), F.lit("?"), urls.query(url)).rlike(EXPORT_URL)
    return F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", "").rlike(EXPORT_LABEL) | own


def kind(url: Column, name: Column, place: Column) -> Column:
    """What a registered URL is, given its host and path; null for a page of the intention portal that is no document."""
    place = F.lower(F.regexp_replace(place, "/+$", ""))
    value = lambda key: F.regexp_extract(urls.query(url), rf"(?i)(?:^|&){key}=([^&]*)", 1).rlike("^[A-Za-z0-9_-]{8,128}$")
    portal = F.when((place == "/cgyx/pub/proj/details") & value("projid"), KINDS[0]).when((place == "/cgyx/pub/details") & value("groupid"), KINDS[1])
    return F.when(name == "cgyx.ccgp.gov.cn", portal).when(place.rlike(r"\.(?:pdf|docx?|xlsx?|zip|rar|7z|ofd|txt)$"), KINDS[3]).otherwise(KINDS[2])


def addressed(rows: DataFrame, url: str) -> DataFrame:
    """rows with what an address claims: official_host, the address over HTTPS in one spelling (empty where the policy refuses it), and whether that changed its transport. Each step has a projection of its own."""
    rows = rows.withColumns({"x_host": urls.host(F.col(url)), "x_port": urls.port(F.col(url)), "x_scheme": urls.scheme(F.col(url))})
    rows = rows.withColumn("x_error", urls.policy_error(F.col(url), F.col("x_host"), F.col("x_port"), F.col("x_scheme")))
    rows = rows.withColumns({"official_host": urls.ascii_host(F.col("x_host")), "transport_upgraded": (F.col("x_scheme") == "http") & F.col("x_port").isin("", "80")})
    upgraded = F.regexp_replace(F.regexp_replace(url, "(?i)^http://", "https://"), "^(https://[^/?#]*):80(?=[/?#]|$)", "$1")
    rows = rows.withColumn("x_https", F.when(F.col("transport_upgraded"), upgraded).otherwise(F.col(url)))
    rows = rows.withColumn("official_url", F.when(F.col("x_error") == "", urls.official_address(F.col("x_https"), F.col("official_host"))).otherwise(""))
    return rows.withColumn("original_url", F.when(F.col("transport_upgraded"), F.regexp_replace(url, "#.*$", "")).otherwise("")).drop("x_https", "x_port", "x_scheme", "x_error")


def candidates(leads: DataFrame, registry: DataFrame, identity: str, url: str, page: str) -> DataFrame:
    """One row for each official URL that a lead page names: (lead_identity, lead_url, official_url, official_host, source_key, kind, transport_upgraded, original_url, method).

    registry: (domain, exact_only, role, key). Links come from attributes, anchors and text; redirect parameters are
    followed; exports and the lead's own host don't count; what is registered as official does, in its one spelling. An address over
    HTTP counts as that over HTTPS where its host is registered, and says so.
    """
    links = leads.select(F.col(identity).alias("lead_identity"), F.col(url).alias("lead_url"), F.explode(html.linked(F.col(url), F.col(page))).alias("link"))
    links = links.where(~is_export(F.col("link.url"), F.col("link.label"), F.col("lead_url")))
    spread = links.select("lead_identity", "lead_url", "link.origin", F.explode("link.targets").alias("target"))
    spread = addressed(spread, "target").where("official_url <> ''").where(F.col("x_host") != urls.host(F.col("lead_url"))).drop("x_host")
    named = urls.registered(spread, "official_host", registry, ("role", "key"), "official_url")
    named = named.where("role = 'official'").withColumn("x_place", urls.path(F.col("official_url")))
    named = named.withColumn("kind", kind(F.col("official_url"), F.col("official_host"), F.col("x_place"))).where("kind is not null")
    own = ("lead_identity", "lead_url", "official_url", "official_host", F.col("key").alias("source_key"), "kind")
    # of two ways to one address, that without a change of transport stands
    first = F.min(F.struct("transport_upgraded", "original_url")).alias("way")
    grouped = named.groupBy(*own).agg(first, F.min("origin").alias("method"))
    return grouped.select("lead_identity", "lead_url", "official_url", "official_host", "source_key", "kind", "way.transport_upgraded", "way.original_url", "method")


def validated(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates with ``valid``: whether everything that they claim follows from their addresses and the registry once more; a changed one doesn't pass."""
    claimed = [F.col(c).alias(f"claimed_{c}") for c in ("official_url", "official_host", "transport_upgraded", "original_url")]
    rows = found.select("*", *claimed, F.when(F.col("transport_upgraded"), F.col("original_url")).otherwise(F.col("official_url")).alias("x_from"))
    rows = addressed(rows.drop("official_url", "official_host", "transport_upgraded", "original_url"), "x_from").drop("x_host")
    rows = urls.registered(rows, "official_host", registry, ("role", "key"), "claimed_official_url")
    same = F.lit(True)
    for c in ("official_url", "official_host", "transport_upgraded", "original_url"):
        same = same & (F.col(c) == F.col(f"claimed_{c}"))
    valid = same & (F.col("role") == "official") & (F.col("key") == F.col("source_key")) & kind(F.col("official_url"), F.col("official_host"), urls.path(F.col("official_url"))).eqNullSafe(F.col("kind")) & (urls.policy_error(F.col("lead_url")) == "")
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return rows.select(*((F.col(f"claimed_{c}").alias(c) if f"claimed_{c}" in rows.columns else F.col(c)) for c in found.columns), "valid")


def ranked(found: DataFrame) -> Column:
    """Sort key: kind in the order of KINDS, then the URL."""
    return F.struct(F.array_position(F.array(*(F.lit(x) for x in KINDS)), F.col("kind")).alias("rank"), F.col("official_url"))


def resolved(found: DataFrame, responses: DataFrame) -> DataFrame:
    """(lead_identity, official_url, verified): for each lead the first candidate whose recorded response passed, else the first with verified false.

    responses: (official_url, passed).
    """
    joined = found.join(responses, "official_url", "left").withColumn("ok", F.coalesce("passed", F.lit(False)))
    best = joined.groupBy("lead_identity").agg(F.min(F.struct((~F.col("ok")).alias("not_ok"), ranked(found).alias("rank"))).alias("best"))
    return best.select("lead_identity", F.col("best.rank.official_url").alias("official_url"), (~F.col("best.not_ok")).alias("verified"))


def title_keys_of(title: str) -> list[str]:
    """Keys that an official row may have for a title: the whole, and its last segment with a key long enough; none for a shorter title.

    Lead sites put the purchaser before a title; a purchaser alone would fit every row, so only the last segment counts.
    """
    plain = unicodedata.normalize("NFKC", unescape(title)).strip()
    whole = gate.normal(plain)
    if len(whole) < LEAST_KEY:
        return []
    segments = (gate.normal(x) for x in reversed(re.split(TITLE_BOUNDARY, plain)[1:]))
    return list(dict.fromkeys([whole, *[x for x in segments if len(x) >= LEAST_KEY][:1]]))


@vectorised_in_parts("array<array<string>>")
def fitting_rows(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(page as text, or as bytes with their content type, content type, title, buyer, code) -> the links of each row that says what is asked for."""
    for batch in in_parts(batches):
        found = []
        for page, content_type, title, *others in zip(*batch, strict=True):
            text = html.decoded(bytes(page), content_type or "") if isinstance(page, (bytes, bytearray, memoryview)) else page
            keys, wanted = title_keys_of(title or ""), [gate.normal(unescape(x or "")) for x in others]
            rows = [(gate.normal(" ".join([row["text"], *(x["url"] for x in row["links"])])), row["links"]) for row in html.parse(text)["rows"]]
            found.append([[x["url"] for x in links] for said, links in rows if any(k in said for k in keys) and all(x in said for x in wanted)])
        yield pd.Series(found, dtype=object)


def row_links(pages: DataFrame, identity: str, page: str, title: Column, buyer: Column, code: Column, content_type: Column | None = None) -> DataFrame:
    """(identity, url): the one link of the one row of a group page that has one of the title's keys, the buyer and the code, in its text or its links; no row where it isn't unique. An empty buyer or code doesn't count; a title too short for a key matches nothing. A page is text, or bytes with their content type."""
    fits = fitting_rows(F.col(page), F.lit("") if content_type is None else content_type, title, buyer, code)
    rows = pages.select(F.col(identity).alias("own"), F.explode(fits).alias("row"))
    links = rows.groupBy("own").agg(F.array_distinct(F.flatten(F.collect_list("row"))).alias("links"))
    return links.where(F.size("links") == 1).select(F.col("own").alias(identity), F.col("links")[0].alias("url"))


def parent_allows(attachments: DataFrame, registry: DataFrame, url: str, parent: str, row: str) -> DataFrame:
    """attachments with ``allowed``: its host is official, so is the notice's, and a host that serves named sources only serves that one.

    registry: (domain, exact_only, role, key, parents array<string>).
    """
    rows = attachments.withColumn("name", urls.host(F.col(url))).withColumn("parent_name", urls.host(F.col(parent)))
    own = urls.registered(rows, "name", registry, ("role", "key", "parents"), row).withColumnsRenamed({"domain": "a_domain", "role": "a_role", "key": "a_key", "parents": "a_parents"})
    both = urls.registered(own, "parent_name", registry, ("role", "key"), row)
    official = F.coalesce((F.col("a_role") == "official") & (F.col("role") == "official"), F.lit(False))
    served = (F.size("a_parents") == 0) | F.array_contains("a_parents", F.col("key"))
    return both.withColumn("allowed", official & F.coalesce(served, F.lit(False)) & urls.is_https(F.col(url))).select(*attachments.columns, "allowed")
