"""Places named in text: a place counts if it is the only one that a piece of evidence names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..shipping import ship

#: What may stand at the end of a province's name.
ENDINGS = ("壮族自治区", "回族自治区", "维吾尔自治区", "特别行政区", "自治区", "省", "市")


def province_alias(name: Column) -> Column:
    return F.regexp_replace(name, f"({'|'.join(ENDINGS)})$", "")


#: Names of cities that are written in another way.
OTHER_NAMES = {"延边": "延边朝鲜族自治州", "长白山管委会": "长白山"}


def canonical_city(value: Column, province: Column, cities: Sequence[str], municipality: Column | None = None) -> Column:
    """A city as the catalogue writes it, with or without the word for city; a value that is the province itself stands only for a municipality; others stay as they are."""
    named = F.coalesce(F.create_map(*(F.lit(x) for p in OTHER_NAMES.items() for x in p))[value], value)
    listed = F.create_map(*(F.lit(x) for c in cities for spelling in dict.fromkeys((c, c.removesuffix("市"))) for x in (spelling, c))) if cities else F.lit(None).cast("map<string,string>")
    whole = F.when(municipality if municipality is not None else F.lit(False), value).otherwise("")
    return F.when(F.coalesce(value, F.lit("")) == "", "").when(value == province, whole).otherwise(F.coalesce(listed[named], named))


def only_place(text: Column, names: Sequence[str]) -> Column:
    """The one name that the text contains; null for none and for several. names is a small dimension, so it is part of the plan."""
    hits = F.filter(F.array(*(F.lit(x) for x in names)), lambda x: F.contains(F.coalesce(text, F.lit("")), x))
    return F.when(F.size(hits) == 1, hits[0])


def by_evidence(evidence: Sequence[Column], names: Sequence[str]) -> Column:
    """The place by the first piece of evidence that names one only; empty if none does."""
    return F.coalesce(*(only_place(x, names) for x in evidence), F.lit(""))


def matched(rows: DataFrame, evidence: Sequence[Column], catalogue: Sequence[tuple[str, str]]) -> DataFrame:
    """rows with province and city: (province, city) pairs make the catalogue; a city decides the province."""
    provinces = sorted({p for p, _ in catalogue})
    city = by_evidence(evidence, sorted({c for _, c in catalogue}))
    owner = F.create_map(*(F.lit(x) for p, c in catalogue for x in (c, p)))
    return rows.withColumn("city", city).withColumn("province", F.coalesce(owner[F.col("city")], by_evidence(evidence, provinces)))


# A name in a text that stands for a place which is written in another way.
NICKNAMES = (("延边", "延边朝鲜族自治州"),)
PLACE = "array<struct<level:int,province:string,city:string,district:string>>"


class Gazetteer:
    """Provinces, cities and districts of a catalogue of any length, found in a text by one pass."""

    def __init__(self, catalogue: Sequence[tuple[str, str | None, str | None]]) -> None:
        """catalogue: (province, city, district); a row without a district names a city, one without a city a province."""
        self.named: dict[str, list[tuple]] = {}
        self.alias: dict[str, list[tuple]] = {}
        self.short: dict[str, list[tuple]] = {}
        for province, city, district in dict.fromkeys(x for p, c, d in catalogue for x in ((p, None, None), (p, c, None), (p, c, d))):
            place = (1 if city is None else 2 if district is None else 3, province, city, district)
            self._add(self.named, district or city or province, place)
            if place[0] == 1:
                self._add(self.alias, re.sub(f"({'|'.join(ENDINGS)})$", "", province), place)
            elif place[0] == 2:
                self._add(self.short, city.removesuffix("市"), place)
                for nickname, of in NICKNAMES:
                    if of == city:
                        self._add(self.named, nickname, place)
        self.trie = terms.Trie([("", name) for name in self.named])

    @staticmethod
    def _add(table: dict, name: str, place: tuple) -> None:
        if name and place not in table.setdefault(name, []):
            table[name].append(place)

    def found(self, text: str, listed: bool) -> list[tuple]:
        """(level, province, city, district) of all places that a text names.

        A province goes by its short name too where that is a part between hyphens, a city where it is the whole text or, in
        a ``listed`` text (of a field for places), the last part.
        """
        out = {place: None for term in dict.fromkeys(x[0] for x in self.trie.spans(text)) for place in self.named[term]}
        parts = text.split("-")
        short = [text.strip(), *([parts[-1]] if listed else [])]
        for table, names_ in ((self.alias, parts), (self.short, short)):
            out |= {place: None for name in names_ for place in table.get(name, ())}
        return list(out)


_GAZETTEERS: dict[str, Gazetteer] = {}


def located(rows: DataFrame, catalogue: DataFrame, listed: Sequence[str] = ("region", "city"), said: Sequence[str] = ("buyer", "title"), district: str | None = None) -> DataFrame:
    """rows with province_found, city_found and district_found (empty where none is).

    catalogue: (province, city, district), a dimension of bounded size (terms.MOST_CHARACTERS). A level's evidence is looked
    at in turn, and the first text that names just one place of that level, within what the level above has found, decides;
    a city or district that is found so decides the province too. Provinces go by region, city, then what is said; cities by
    city, region, then what is said; districts by the district's own text first. Null texts name nothing.
    """
    spark = rows.sparkSession
    size = catalogue.agg(F.coalesce(F.sum(F.length(F.concat_ws("", "province", "city", "district"))), F.lit(0))).first()[0]
    if size > terms.MOST_CHARACTERS:
        raise ValueError("too many places for a catalogue")
    entries, key = spark.sparkContext.broadcast([tuple(r) for r in catalogue.where("province is not null").select("province", "city", "district").distinct().orderBy("province", "city", "district").collect()]), uuid.uuid4().hex
    ship(spark)

    def function(in_field: bool):
        def run(text: pd.Series) -> pd.Series:
            if key not in _GAZETTEERS:
                _GAZETTEERS[key] = Gazetteer(entries.value)
            find = _GAZETTEERS[key].found
            return pd.Series([[] if x is None else find(x, in_field) for x in text], dtype=object)

        return F.pandas_udf(run, PLACE)

    region, city = listed
    texts = {"x_region": (region, True), "x_city": (city, True), **{f"x_said{n}": (c, False) for n, c in enumerate(said)}}
    if district:
        texts["x_district"] = (district, False)
    fields_, free = function(True), function(False)
    found = rows.withColumns({name: (fields_ if in_field else free)(F.coalesce(F.col(c), F.lit(""))) for name, (c, in_field) in texts.items()})
    spoken = [f"x_said{n}" for n in range(len(said))]

    def one(level: int, names_: list[str], within) -> Column:
        return F.coalesce(*(terms.only(F.filter(n, lambda p: (p["level"] == level) & within(p))) for n in names_))

    found = found.withColumn("x_p", one(1, ["x_region", "x_city", *spoken], lambda p: F.lit(True)))
    inside = lambda p: F.col("x_p").isNull() | (p["province"] == F.col("x_p.province"))
    found = found.withColumn("x_c", one(2, ["x_city", "x_region", *spoken], inside))
    of = F.coalesce(F.col("x_c.province"), F.col("x_p.province"))
    within = lambda p: (of.isNull() | (p["province"] == of)) & (F.col("x_c").isNull() | (p["city"] == F.col("x_c.city")))
    found = found.withColumn("x_d", one(3, [*(["x_district"] if district else []), "x_city", "x_region", *spoken], within))
    empty = F.lit("")
    return found.select(
        *rows.columns,
        F.coalesce("x_d.province", "x_c.province", "x_p.province", empty).alias("province_found"),
        F.coalesce("x_d.city", "x_c.city", empty).alias("city_found"),
        F.coalesce("x_d.district", empty).alias("district_found"),
    )
