"""Amounts in minor units: parsed, chosen, shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import one_of

NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
UNIT = "(万元|万|元)"
#: Which of several amounts a notice is known by, and the name of that kind.
PRECEDENCE = (("contract_amount_minor", "contract"), ("award_amount_minor", "award"), ("budget_amount_minor", "budget"), ("max_price_minor", "max_price"), ("intention_amount_minor", "intention"))


def minor(number: Column, unit: Column) -> Column:
    """A decimal with thousands commas, in 10 000s where the unit says so, as whole cents rounded half up; null if it is none or out of range."""
    value = F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(38,6)")
    cents = F.round(value * F.when(unit.isin("万元", "万"), 1_000_000).otherwise(100).cast("decimal(7,0)"), 0)
    return F.when((value >= 0) & (value <= 10**16) & (cents <= 10**18), cents.try_cast("long"))


def named(text: Column, labels: Sequence[str]) -> tuple[Column, Column]:
    """(number, unit) after the first label that one follows; the unit stands behind it or in brackets behind the label."""
    pattern = f"(?i)(?:{one_of(labels)})" + r"\s*((?:（[^）]{0,20}）|\([^)]{0,20}\))?)\s*[:：]?\s*" + NUMBER + r"\s*" + UNIT + "?"
    unit = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 3), F.lit("")), F.regexp_extract(F.regexp_extract(text, pattern, 1), UNIT, 1))
    return F.regexp_extract(text, pattern, 2), unit


def after_label(text: Column, labels: Sequence[str]) -> Column:
    """The amount after the first label that one follows. Where several are wanted, with_amounts() looks into the text less often."""
    return minor(*named(text, labels))


def with_amounts(rows: DataFrame, text: Column, amounts: dict[str, Sequence[str]]) -> DataFrame:
    """rows with the amount after the labels of each name. Numbers and units have a projection of their own, so that each pattern is applied once."""
    found = {f"{part}_{name}": c for name, labels in amounts.items() for part, c in zip(("x_n", "x_u"), named(text, labels), strict=True)}
    rows = rows.withColumns(found)
    return rows.withColumns({name: minor(F.col(f"x_n_{name}"), F.col(f"x_u_{name}")) for name in amounts}).drop(*found)


def yuan(amount: Column) -> Column:
    """Cents as a decimal with two places, by whole-number arithmetic; empty for null."""
    size = F.abs(amount)
    whole = F.call_function("div", size, F.lit(100))
    return F.when(amount.isNull(), "").otherwise(F.format_string("%s%d.%02d", F.when(amount < 0, "-").otherwise(""), whole, size % 100))


def primary(present: dict[str, Column]) -> tuple[Column, Column]:
    """(amount, kind) of the first amount by PRECEDENCE that isn't null; kind is empty if all are."""
    order = [(present[c], kind) for c, kind in PRECEDENCE if c in present]
    amount = F.coalesce(*(c for c, _ in order))
    kind = F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for c, k in order), F.lit(""))
    return amount, kind
