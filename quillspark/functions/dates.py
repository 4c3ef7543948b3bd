"""Dates found in text, validated; windows of dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .patterns import one_of

_DAY = r"(20[0-9]{2})\s*[-/.年]\s*([0-9]{1,2})\s*[-/.月]\s*([0-9]{1,2})日?"
_TIME = r"(?:\s*([0-9]{1,2})\s*[:时]\s*([0-9]{1,2})(?:\s*分)?)?"


def _day(text: Column, pattern: str, first: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, 0)  # the text is searched once, its parts are taken from what was found
    parts = [F.regexp_extract(found, pattern, first + i) for i in range(3)]
    return F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")


def labelled_date(text: Column, labels: Sequence[str]) -> Column:
    """The date after the first label that one follows, as yyyy-MM-dd, with HH:mm if a time follows; empty if it isn't on the calendar."""
    pattern = f"(?:{one_of(labels)})" + r"\s*[:：]?\s*" + _DAY + _TIME
    day = F.date_format(_day(text, pattern), "yyyy-MM-dd")
    found = F.regexp_extract(text, pattern, 0)
    hour, minute = (F.regexp_extract(found, pattern, i).try_cast("int") for i in (4, 5))
    time = F.when(hour.isNull(), "").when((hour < 24) & (minute < 60), F.format_string(" %02d:%02d", hour, minute))
    return F.coalesce(F.concat(day, time), F.lit(""))


def any_date(text: Column) -> Column:
    """The first date anywhere in the text, as yyyy-MM-dd; null if there is none or it isn't on the calendar."""
    return F.date_format(_day(text, _DAY), "yyyy-MM-dd")


def last_date(text: Column) -> Column:
    """The last date in the text."""
    return any_date(F.try_element_at(F.regexp_extract_all(text, F.lit("(" + _DAY + ")"), F.lit(1)), F.lit(-1)))


def expected_month(text: Column, label: str = "预计采购时间") -> Column:
    """yyyy-MM after the label; empty if there is none or the month isn't 1 to 12."""
    pattern = label + r"\s*[:：]?\s*(20[0-9]{2})\s*[-/.年]\s*([0-9]{1,2})月?"
    month = F.regexp_extract(text, pattern, 2).try_cast("int")
    return F.coalesce(F.when(month.between(1, 12), F.format_string("%s-%02d", F.regexp_extract(text, pattern, 1), month)), F.lit(""))


def http_date(text: Column) -> Column:
    """A date as HTTP headers write it, as a timestamp; the day of the week isn't looked at."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\s*[A-Za-z]+,\s*", ""), F.lit("dd MMM yyyy HH:mm:ss z"))


def preferred(*choices: tuple[str, Column]) -> Column:
    """(date, source) of the first choice that is filled; empty strings if none is."""
    none = F.struct(F.lit("").alias("date"), F.lit("").alias("source"))
    found = [F.when(F.coalesce(c, F.lit("")) != "", F.struct(c.alias("date"), F.lit(n).alias("source"))) for n, c in choices]
    return F.coalesce(*found, none)


def windows(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """(window_start, window_end): start to end in steps of ``days``, the last one cut at the end."""
    if days < 1:
        raise ValueError("days must be at least 1")
    first = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {days} days"))).alias("window_start")
    return spark.range(1).select(first).select("window_start", F.least(F.date_add("window_start", days - 1), F.lit(end).cast("date")).alias("window_end"))


def windows_of(spans: DataFrame, first: str, last: str, days: int) -> DataFrame:
    """spans with first and last of each window instead of the whole span's: steps of ``days``, the last one cut at the end; no rows for nulls."""
    if days < 1:
        raise ValueError("days must be at least 1")
    others = [c for c in spans.columns if c not in (first, last)]
    start = F.explode(F.sequence(F.col(first), F.col(last), F.expr(f"interval {days} days")))
    rows = spans.select(*others, start.alias("first"), F.col(last).alias("until"))
    return rows.select(*others, "first", F.least(F.date_add("first", days - 1), F.col("until")).alias("last"))
