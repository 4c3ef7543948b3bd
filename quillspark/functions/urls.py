"""URL columns: canonical keys, a strict policy, registered domains by longest suffix."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import spread_join
from ..shipping import vectorised
from . import text

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "from", "spm")


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), ":([0-9]+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _spelled(part: Column) -> Column:
    """A query's key or value, decoded and encoded again: one spelling of each text. What can't be decoded is taken as it stands."""
    plain = F.coalesce(F.try_url_decode(part), part)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_key(url: Column) -> Column:
    """Host, port unless a default, path and sorted query: what two spellings of one address have in common.

    Scheme and fragment don't count, nor tracking parameters, doubled slashes and one at the end.
    """
    number = port(url)
    shown = F.when((number == "") | number.isin("80", "443"), "").otherwise(F.concat(F.lit(":"), number))
    tidy = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "/+$", "")
    pairs = F.filter(F.split(query(url), "&"), lambda x: x != "")
    # pairs sort by key, then value, as decoded
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    halves = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=?", "").alias("v")))
    sortable = F.transform(halves, lambda x: F.struct(decoded(x["k"]).alias("key"), decoded(x["v"]).alias("value"), x["k"].alias("k"), x["v"].alias("v")))
    kept = F.array_sort(F.filter(sortable, lambda x: ~F.lower(x["key"]).isin(*TRACKING)))
    joined = F.array_join(F.transform(kept, lambda x: F.concat(_spelled(x["k"]), F.lit("="), _spelled(x["v"]))), "&")
    return F.concat(host(url), shown, F.when(tidy == "", "/").otherwise(tidy), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


def file_name(url: Column, fallback: str = "source.bin") -> Column:
    """The last part of the path as a safe name."""
    return text.safe_component(F.coalesce(F.nullif(F.regexp_extract(path(url), "([^/]*)/*$", 1), F.lit("")), F.lit(fallback)), fallback)


#: A host name has two labels at least, of letters, digits and hyphens, none at an end.
HOST = r"(?!-)[a-z0-9-]{1,63}(?<!-)(?:\.(?!-)[a-z0-9-]{1,63}(?<!-))+"


@vectorised("string")
def ascii_host(name: pd.Series) -> pd.Series:
    """A host name in lower case and ASCII; empty if it is none: no dot, a dot at its end, an empty, long or hyphened label."""

    def one(name: str | None) -> str:
        try:
            short = (name or "").strip().lower().encode("idna").decode("ascii")
        except UnicodeError:
            return ""
        return short if re.fullmatch(HOST, short) else ""

    return pd.Series([one(x) for x in name])


def official_address(url: Column, name: Column) -> Column:
    """The one spelling of an HTTPS address that policy_error() finds nothing against, given its ASCII host: no fragment, no default port, a path; empty for others."""
    number, asked = port(url), F.regexp_extract(url, r"^[^#?]*(\?[^#]*)", 1)
    shown = F.when(number.isin("", "443"), "").otherwise(F.concat(F.lit(":"), number))
    place = F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/"))
    return F.when((scheme(url) == "https") & (name != ""), F.concat(F.lit("https://"), name, shown, place, asked)).otherwise("")


def is_https(url: Column) -> Column:
    return F.coalesce(F.startswith(F.lower(url), F.lit("https://")), F.lit(False))


def policy_error(url: Column, name: Column | None = None, number: Column | None = None, kind: Column | None = None) -> Column:
    """The first reason to refuse an address, empty if there is none. Its host, port and scheme may be given, so that a plan has them once."""
    name, number, kind = host(url) if name is None else name, port(url) if number is None else number, scheme(url) if kind is None else kind
    label = r"(?!-)[\p{L}\p{N}-]{1,63}(?<!-)"
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "empty")
        .when(url.rlike(r"[\x00-\x20\x7f]"), "blank_or_control")
        .when(F.contains(url, F.lit("\\")), "backslash")
        .when(~kind.isin("http", "https"), "scheme")
        .when(F.contains(authority(url), F.lit("@")), "user_info")
        .when(name == "", "no_host")
        .when(~name.rlike(rf"^{label}(\.{label})+$"), "host")
        .when((number != "") & ~number.isin("80", "443"), "port")
        .when(((kind == "https") & (number == "80")) | ((kind == "http") & (number == "443")), "scheme_port")
        .otherwise("")
    )


def matches_domain(name: Column, domain: Column) -> Column:
    """The domain itself or a real subdomain of it."""
    return (name == domain) | F.endswith(name, F.concat(F.lit("."), domain))


def suffixes(name: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]"""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def registered(rows: DataFrame, name: str, registry: DataFrame, keep: tuple[str, ...], row: str) -> DataFrame:
    """rows with the columns ``keep`` of the registration whose domain is the longest suffix of column ``name``; null where none is.

    registry: (domain, exact_only boolean, keep...), one row for each domain. Every host is looked up by its few suffixes,
    an equi-join; ``row`` identifies a row. Rows with one host share one lookup.
    """
    hosts = rows.select(F.col(name).alias("reg_host")).distinct()
    spread = hosts.select("reg_host", F.explode(suffixes(F.col("reg_host"))).alias("domain"))
    found = spread.join(registry, "domain").where(~F.col("exact_only") | (F.col("domain") == F.col("reg_host")))
    best = found.groupBy("reg_host").agg(F.max_by(F.struct("domain", *keep), F.length("domain")).alias("reg"))
    named = best.select("reg_host", F.col("reg.domain").alias("domain"), *(F.col(f"reg.{c}").alias(c) for c in keep))
    return spread_join(rows.withColumn("reg_host", F.col(name)), named, "reg_host", row, "left").drop("reg_host")
