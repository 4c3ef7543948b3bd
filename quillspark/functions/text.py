"""String columns: normalising, matching, shingles, safe names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "__unknown__"
#: Names that a file system keeps for itself.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def blank(column: Column) -> Column:
    """Null and the empty string count as the same."""
    return F.coalesce(column, F.lit("")) == ""


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank, trimmed; null if none is."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def contains_text(column: Column, value: str) -> Column:
    """Substring match without regard to case; % and _ in value are ordinary characters."""
    return F.contains(F.lower(column), F.lit(value.lower()))


def matches_filter(column: Column, value: str, exact: bool = False) -> Column | None:
    """The condition of one catalogue filter: none for an empty value, blankness for the unknown marker, else a substring, or with ``exact`` the whole."""
    value = value.strip()
    if not value:
        return None
    if exact and value != UNKNOWN:
        return F.coalesce(F.trim(column) == value, F.lit(False))
    return blank(column) if value == UNKNOWN else contains_text(F.coalesce(column, F.lit("")), value)


def clean_lines(text: Column) -> Column:
    """Ideographic spaces become spaces, runs of blanks one; lines are trimmed and empty ones go."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "　", " "), r"\r\n?", "\n"), "\n")
    trimmed = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\t\f\x0B ]+", " ")))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def collapse(text: Column) -> Column:
    """Every run of white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def search_key(text: Column) -> Column:
    """ASCII letters, digits and Han characters only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^0-9A-Za-z一-鿿]+", ""))


def letters_key(text: Column) -> Column:
    """Letters and digits of any script, in lower case (compatibility forms are left as they are)."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def shingles(text: Column, width: int) -> Column:
    """The distinct substrings of ``width`` characters; a shorter text is one, an empty one none.

    The text is split into characters once: to find a place in it takes a walk from its beginning.
    """
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    places = lambda c: F.sequence(F.lit(1), F.greatest(F.size(c) - (width - 1), F.lit(1)))
    # a lambda over one element binds the characters to a name, so that they are not split again at every place
    runs = F.flatten(F.transform(F.array(letters), lambda c: F.transform(places(c), lambda i: F.array_join(F.slice(c, i, F.lit(width)), ""))))
    return F.when(F.length(text) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def overlap(a: Column, b: Column, of: Column) -> Column:
    """Common elements of two arrays of distinct elements, as a share of ``of``."""
    return F.size(F.array_intersect(a, b)) / of


def same_rendering(a: Column, b: Column, least: float = 0.55) -> Column:
    """Whether two normalised texts say the same: one contains the other, or enough of the smaller one's 4-character shingles."""
    both = F.array(F.struct(shingles(a, 4).alias("a"), shingles(b, 4).alias("b")))
    share = F.transform(both, lambda s: overlap(s["a"], s["b"], F.least(F.size(s["a"]), F.size(s["b"]))))[0]
    return F.when((a == "") | (b == ""), a == b).otherwise(F.contains(a, b) | F.contains(b, a) | (share >= least))


def semantic_match(expected: Column, actual: Column, fuzzy: bool = False) -> Column:
    """Whether ``actual`` has ``expected`` in it, both normalised; ``fuzzy`` also accepts four fifths of the 2-character shingles of 8 characters and more."""
    found = (expected == "") | F.contains(actual, expected)
    if not fuzzy:
        return found
    two = shingles(expected, 2)
    return found | ((F.length(expected) >= 8) & (overlap(two, shingles(actual, 2), F.size(two)) >= 0.8))


def head_and_tail(text: Column, most: int = 16_000, head: int = 8_000, tail: int = 8_000, mark: str = "\n…\n") -> Column:
    """A text over ``most`` characters as its beginning, a mark and its end."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)


def csv_safe(column: Column) -> Column:
    """A quote before texts that a spreadsheet would take for a formula."""
    return F.when(column.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), column)).otherwise(column)


def stable_id(column: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(column, 256), 1, length)


def safe_component(value: Column, fallback: str = "unnamed", most: int = 120) -> Column:
    """A name that may be part of a path: percent-decoded, forbidden characters replaced, blanks collapsed, long names shortened with a hash."""
    plain = F.trim(F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value, F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " "), r"[. ]+$", "")
    named = F.when(tidy == "", F.lit(fallback)).otherwise(tidy)
    named = F.when(F.upper(F.substring_index(named, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), named)).otherwise(named)
    tail = F.regexp_extract(named, r"[^.](\.[^.]{1,15})$", 1)
    room = F.greatest(F.lit(most - 9) - F.length(tail), F.lit(1))
    short = F.concat(F.substring(named, F.lit(1), room), F.lit("_"), F.substring(F.sha2(named, 256), 1, 8), tail)
    return F.when(F.length(named) > most, F.left(short, F.lit(most))).otherwise(named)
