"""What a user asks for, checked, and compiled to conditions on notices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import catalog

#: An industry also goes by these words.
SYNONYMS = {name: terms for name, terms in lexicon.INDUSTRY_RULES}
MODES = ("fast", "recall")


@dataclass(frozen=True)
class Criteria:
    """A query over a range of days; empty texts ask for nothing."""

    start_date: str
    end_date: str
    province: str = ""
    city: str = ""
    district: str = ""
    industry: str = ""
    keyword: str = ""
    notice_type: str = ""
    mode: str = "recall"
    max_candidates: int = 100

    def __post_init__(self) -> None:
        first, last = date.fromisoformat(self.start_date), date.fromisoformat(self.end_date)
        if first > last:
            raise ValueError("the first day is after the last")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if isinstance(self.max_candidates, bool) or not 10 <= self.max_candidates <= 500:
            raise ValueError("max_candidates must be 10 to 500")
        if (self.city or self.district) and not self.province or self.district and not self.city:
            raise ValueError("a place needs those it lies in")

    @property
    def terms(self) -> tuple[str, ...]:
        """Words to look for: the keyword, unless it only repeats the industry; else the industry and its synonyms."""
        word = "" if self.keyword.strip() == self.industry else self.keyword.strip()
        if word:
            return (word,)
        return (self.industry, *SYNONYMS.get(self.industry, ())) if self.industry else ()

    @property
    def region(self) -> str:
        return "-".join(x for x in (self.province, self.city, self.district) if x)

    def conditions(self, day: Column, region: Column, title: Column, buyer: Column, kind: Column) -> list[Column]:
        """Conditions that notices meet; filtered() takes them."""
        out = [catalog.day_between(day, self.start_date, self.end_date)]
        out += [F.contains(F.coalesce(region, F.lit("")), F.lit(x)) for x in (self.province, self.city, self.district) if x]
        if self.terms:
            said = F.lower(F.concat_ws(" ", title, buyer))
            out.append(F.exists(F.array(*(F.lit(t.lower()) for t in self.terms)), lambda t: F.contains(said, t)))
        if self.notice_type:
            out.append(F.contains(F.coalesce(kind, F.lit("")), F.lit(self.notice_type)))
        return out

    def supported(self, capabilities: Mapping[str, Sequence[str]]) -> dict[str, str]:
        """For each source 'ok', or the first asked thing that it can't filter by."""
        asked = [n for n in ("province", "city", "district", "industry", "keyword", "notice_type") if getattr(self, n)]
        return {source: next((n for n in asked if n not in can), "ok") for source, can in capabilities.items()}


def recalled(terms_hit: Column, has_attachments: Column, mode: str, asked: bool) -> Column:
    """Whether a notice passes recall: a term, attachments unless fast, or a query that named it already."""
    return terms_hit | (has_attachments if mode != "fast" else F.lit(False)) | F.lit(asked)


def checked_thresholds(review: float, accept: float) -> tuple[float, float]:
    if not 0 <= review <= accept <= 1:
        raise ValueError("thresholds must be 0 <= review <= accept <= 1")
    return review, accept
