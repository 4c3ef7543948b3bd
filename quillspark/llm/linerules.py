"""Line-first quality rules: bad lines go first, then documents that lose too much of their text with them.

Per line: punctuation (a line must end a sentence, and must not be strewn with marks), navigation (bars, arrows and the
like between words), boilerplate (stock phrases of sites and licences). A line without a word is no line. What remains is
the cleaned text; a document that loses more than ``MOST_LOST`` of its word characters is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, slices

#: What ends a sentence, also before closing quotes and brackets.
ENDS = tuple(".!?:;…。！？")
CLOSERS = "\"'”’»)]"
#: Marks that a clean text has few of.
SYMBOLS = "#*$%&|<>"
#: What menus and link lists put between their entries.
SEPARATORS = ("|", "»", "›", "•", "·", "→")
#: Stock phrases, in lower case.
BOILERPLATE = re.compile("all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|use of cookies|enable javascript|lorem ipsum|click here|sign up now|subscribe to our newsletter|powered by|skip to content")
MOST_LOST = 0.5
#: A line fails with more separators than this for each word, with more marks, or with more shouted words.
NAVIGATION_SHARE, SYMBOL_SHARE, SHOUT_SHARE = 0.2, 0.3, 0.5


class Verdict(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_punctuation: int
    n_navigation: int
    n_boilerplate: int
    lost_chars: int
    cleaned: str


def line_fault(line: str, words: list[bytes]) -> str:
    """punctuation, navigation or boilerplate for the first rule that the line breaks; empty if it breaks none."""
    n = len(words)
    if sum(map(line.count, SEPARATORS)) > NAVIGATION_SHARE * n:
        return "navigation"
    if BOILERPLATE.search(line.lower()):
        return "boilerplate"
    end = line.rstrip(" \t\r\v\f" + CLOSERS)
    if not end.endswith(ENDS) or sum(map(line.count, SYMBOLS)) > SYMBOL_SHARE * n or line.count("!!") > SHOUT_SHARE * n:
        return "punctuation"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a run of three that stands in the text at least twice."""
    runs = list(zip(words, words[1:], words[2:], strict=False))
    if len(runs) == len(set(runs)):
        return 0
    often = {x for x, n in Counter(runs).items() if n > 1}
    total, upto = 0, 0
    for i, run in enumerate(runs):
        if run in often:
            total += i + 3 - max(upto, i)
            upto = i + 3
    return total


def judge(text: str | None) -> Verdict:
    """All counts and the verdict for one whole text; null counts as empty."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = sum(map(len, map(bytes.decode, words)))
    repeat = repeated_words(words)
    seen, dup, kept, lost, faults = set(), 0, [], 0, Counter()
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            continue
        dup += line in seen
        seen.add(line)
        if fault := line_fault(line, own):
            faults[fault] += 1
            lost += sum(map(len, map(bytes.decode, own)))
        else:
            kept.append(line)
    base = n < 50 or 100 * repeat > 50 * n
    return Verdict(n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, base, not base and lost <= MOST_LOST * chars, faults["punctuation"], faults["navigation"], faults["boilerplate"], lost, "\n".join(kept))


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_punctuation long, n_navigation long, n_boilerplate long, lost_chars long"


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """(key, counts, base_failed, kept, failed lines by rule, lost_chars, and with ``texts`` the cleaned text) for each row.

    A null or empty text has no words and fails the base rules; repeated rows give repeated results; no rows give no rows. Very long texts are
    judged whole. Other columns are left out, so their names can't clash.
    """
    names = ["key", *(x.split()[0] for x in FIELDS.split(", ")), *["cleaned"] * texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = list(zip(*map(judge, part.column(1).to_pylist()), strict=True))
                cols = [pa.array(x, pa.bool_() if isinstance(x[0], bool) else pa.string() if isinstance(x[0], str) else pa.int64()) for x in cols]
                yield pa.record_batch([part.column(0), *cols[: len(names) - 1]], names)

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return mapped(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, {FIELDS}" + ", cleaned string" * texts).withColumnRenamed("key", key)
