"""Many terms in one pass: a trie with failure links over a dictionary of any length, instead of a search for each term.

A dictionary is a dimension: pairs (name, term), where a name (a rule, a category, a place) may have several terms and a
term several names. It goes to each executor once, as a broadcast of bounded size, and each Python worker builds its trie
once. The time a text takes follows its length and its hits, not the number of terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import in_parts, ship

#: A dictionary of more characters is refused: it would be no dimension any more.
MOST_CHARACTERS = 64_000_000
HITS = "array<struct<name:string,term:string,count:int,first:int>>"
SPANS = "array<struct<term:string,start:int,end:int>>"

_BUILT: dict[str, Trie] = {}


class Trie:
    """Finds all terms of a dictionary in a text at once, also those that overlap or lie in each other."""

    def __init__(self, entries: Sequence[tuple[str, str]]) -> None:
        self.names: dict[str, list[tuple[int, str]]] = {}
        for order, (name, term) in enumerate(entries):
            self.names.setdefault(term, []).append((order, name))
        self.trie = ahocorasick.Automaton()
        for term in self.names:
            self.trie.add_word(term, term)
        if self.names:
            self.trie.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(term, start, end) by their ends, then the longer first; places count characters from 0."""
        return [(term, end + 1 - len(term), end + 1) for end, term in self.trie.iter(text)] if self.names else []

    def hits(self, text: str) -> list[tuple[str, str, int, int]]:
        """(name, term, how often, first place) for each entry of the dictionary that occurs, in its order."""
        seen: dict[str, list[int]] = {}
        for term, start, _ in self.spans(text):
            at = seen.setdefault(term, [0, start])
            at[0] += 1
        found = [(order, name, term, n, first) for term, (n, first) in seen.items() for order, name in self.names[term]]
        return [x[1:] for x in sorted(found)]


class Dictionary:
    """Pairs (name, term) for all executors; empty terms are left out."""

    def __init__(self, entries: Iterable[tuple[str, str]]) -> None:
        self.entries = [(name, term) for name, term in entries if term]
        if sum(len(term) for _, term in self.entries) > MOST_CHARACTERS:
            raise ValueError("too many terms for a dictionary")
        self.key = uuid.uuid4().hex
        self._sent: dict[str, object] = {}

    @classmethod
    def of(cls, rows: DataFrame, name: str, term: str, order: Sequence[str] = ()) -> Dictionary:
        """A dictionary from a dimension table, whose size is looked at before it comes to the driver."""
        size = rows.agg(F.coalesce(F.sum(F.length(term)), F.lit(0))).first()[0]
        if size > MOST_CHARACTERS:
            raise ValueError("too many terms for a dictionary")
        return cls((r[0], r[1]) for r in rows.where(F.col(term).isNotNull()).orderBy(*(order or (name, term))).select(name, term).collect())

    @classmethod
    def rules(cls, rules: Sequence[tuple[str, Sequence[str]]]) -> Dictionary:
        """A dictionary of rules with their terms, in lower case, in their order."""
        return cls((name, term.lower()) for name, terms in rules for term in terms)

    def _function(self, returns: str, method: str):
        spark = SparkSession.active()
        ship(spark)
        application = spark.sparkContext.applicationId
        if application not in self._sent:
            self._sent = {application: spark.sparkContext.broadcast(self.entries)}
        entries, key = self._sent[application], self.key

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if key not in _BUILT:
                _BUILT[key] = Trie(entries.value)
            find = getattr(_BUILT[key], method)
            for text in in_parts(batches):
                yield pd.Series([None if x is None else find(x) for x in text], dtype=object)

        return F.pandas_udf(run, returns)

    def hits(self, text: Column) -> Column:
        """For each entry that occurs in the text: its name, term, how often and where first; null for a null text."""
        return self._function(HITS, "hits")(text)

    def spans(self, text: Column) -> Column:
        """All places of all terms."""
        return self._function(SPANS, "spans")(text)


def names(hits: Column) -> Column:
    """The names that have a hit, each once, in the dictionary's order."""
    return F.array_distinct(F.transform(F.coalesce(hits, F.array().cast(HITS)), lambda h: h["name"]))


def terms_of(hits: Column, name: str) -> Column:
    """The terms of one name that occur, in the dictionary's order."""
    own = F.filter(F.coalesce(hits, F.array().cast(HITS)), lambda h: h["name"] == name)
    return F.array_distinct(F.transform(own, lambda h: h["term"]))


def only(found: Column) -> Column:
    """The one value of an array; null for none and for several."""
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))


def first(found: Column, default: str) -> Column:
    """The first value of an array, or the default."""
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(default))
