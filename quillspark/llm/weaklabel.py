"""Quality classifier from weak labels.

Eight heuristic labellers vote good (1) or bad (0) on each whole text, or abstain: undecided (2), where a measure lies between its bounds, or
for want of evidence (3), where a text has too little to measure. How often each combination of votes occurs
is counted over all documents - at most 4 ** 8 combinations - and expectation maximisation on these counts estimates each
labeller's accuracy and the share of good documents, as if labellers err independently given the true class. The
posterior of a document's combination is its soft label. A linear scorer on hashed words and word shapes is fitted to the soft labels of
a bounded sample, and then scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE, mapped, sampled, slices

#: Undecided, which may be likelier in one class; and no evidence, which tells nothing of the class.
UNDECIDED, SILENT = 2, 3
#: A text of fewer words is too short for shares of its words to mean much: labellers that need them abstain.
FEW = 12
SPACE = 1 << 16
#: About so many different documents at most are fitted to: those with the smallest hash of the text.
SAMPLE = 4000
LABELLERS = ("symbols", "sentence_ends", "repeated_lines", "word_length", "function_words", "repeated_runs", "capitals", "separators")
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(b"the of and to in is that it for as with was on by be are this from at or an die der und den von zu das mit sich des auf ist im dem nicht ein eine als auch es le la les de et un une du que qui dans en pour par sur au el los las del que y con para una su al lo como".split())
_ENDS = (b".", b"!", b"?", b":", b";", b'."', b".)")


def votes(text: str | None) -> tuple[int, ...]:
    """One vote for each of LABELLERS. A text without words gets bad from the labeller of word length, and silence."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    if not n:
        return tuple(0 if x == "word_length" else SILENT for x in LABELLERS)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    choose = lambda x, bad, good: 0 if x >= bad else 1 if x <= good else UNDECIDED
    few = n < FEW
    runs = list(zip(words, words[1:], words[2:], strict=False))
    letters = sum(map(len, words)) / n
    known = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    ended = sum(x.encode().endswith(_ENDS) for x in lines) / len(lines)
    upper = len(re.findall("[A-ZÀ-ÖØ-Þ]{2,}", text)) / n
    return (
        choose(sum(map(text.count, "#*$%&<>")) / n, 0.2, 0.02),
        choose(1 - ended, 0.7, 0.1),
        choose(1 - len(set(lines)) / len(lines), 0.3, 0.05) if len(lines) > 3 else SILENT,
        SILENT if few else choose(abs(letters - 6.5), 5.0, 2.0),
        SILENT if few else 0 if known < 0.03 else 1 if known > 0.12 else UNDECIDED,
        choose(1 - len(set(runs)) / len(runs), 0.3, 0.05) if len(runs) > 20 else SILENT,
        choose(upper, 0.3, 0.02),
        choose(sum(map(text.count, "|»•›")) / n, 0.15, 0.01),
    )


class LabelModel(NamedTuple):
    """share: prior of good. chance[class, labeller, vote]: probability of a vote given the class, where the labeller has evidence; without, it has 1."""

    share: float
    chance: np.ndarray

    def posterior(self, ballots: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        at = np.arange(ballots.shape[1])
        good, bad = (np.log(p) + np.log(self.chance[c, at, ballots]).sum(1) for c, p in ((1, self.share), (0, 1 - self.share)))
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))

    def accuracy(self) -> np.ndarray:
        """For each labeller, how probable its vote is right where it votes."""
        prior = (1 - self.share, self.share)
        right = sum(prior[c] * self.chance[c, :, c] for c in (0, 1))
        return right / np.maximum(sum(prior[c] * self.chance[c, :, :UNDECIDED].sum(1) for c in (0, 1)), 1e-12)


def estimate(ballots: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation maximisation on distinct combinations and their counts, from the majority of votes on; add-one smoothing."""
    majority = (ballots == 1).sum(1) - (ballots == 0).sum(1)
    belief = 1 / (1 + np.exp(-majority.astype(float)))
    model = LabelModel(0.5, np.ones((2, ballots.shape[1], 4)))
    for _ in range(rounds):
        chance = np.ones((2, ballots.shape[1], 4))
        for c, weight in ((1, counts * belief), (0, counts * (1 - belief))):
            for vote in range(SILENT):
                chance[c, :, vote] = ((ballots == vote) * weight[:, None]).sum(0) + 1
            chance[c, :, :SILENT] /= chance[c, :, :SILENT].sum(1, keepdims=True)
        model = LabelModel(float(np.clip((counts * belief).sum() / max(counts.sum(), 1), 0.001, 0.999)), chance)
        new = model.posterior(ballots)
        done = len(new) == 0 or np.abs(new - belief).max() < 1e-9
        belief = new
        if done:
            break
    return model


class _Slots(dict):
    """Word -> its two places among the hashed weights: the word itself in lower case, and its shape."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > CACHE:
            self.clear()
        shape = re.sub(rb"([^\W\d_]|[\x80-\xff])+", lambda m: b"A" if m[0].isupper() and len(m[0]) > 1 else b"a", re.sub(rb"\d+", b"0", word))
        self[word] = found = (xxhash.xxh32_intdigest(word.lower()) % SPACE, SPACE + xxhash.xxh32_intdigest(shape, 1) % SPACE)
        return found


#: The place of a pair of neighbouring words that stood in the text before.
AGAIN = 2 * SPACE
#: A text's places are averaged as if there were so many more that say nothing: few words change little.
CALM = 20


def places(text: str | None, slots: _Slots) -> np.ndarray:
    """Every word's two places, and AGAIN for each repeated pair."""
    words = (text or "").encode().split()
    again = max(0, len(words) - 1) - len(set(zip(words, words[1:], strict=False)))
    return np.array([*chain.from_iterable(map(slots.__getitem__, words)), *[AGAIN] * again], np.int64)


class Scorer(NamedTuple):
    weight: np.ndarray
    bias: float

    def of(self, at: np.ndarray) -> float:
        """Probability of good: logistic of the calmed mean weight of the text's places."""
        x = float(self.weight[at].sum()) / (len(at) + CALM) + self.bias
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 60, rate: float = 0.5) -> Scorer:
    """Logistic regression on soft labels, by Adam over all rows at once. rows: distinct places and the share of the text's places that each has."""
    weight, bias = np.zeros(2 * SPACE + 1), 0.0
    if not rows:
        return Scorer(weight, bias)
    row = np.repeat(np.arange(len(rows)), [len(x[0]) for x in rows])
    at, share = np.concatenate([x[0] for x in rows]), np.concatenate([x[1] for x in rows])
    m, v, mb, vb = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
    for step in range(1, rounds + 1):
        score = np.bincount(row, weight[at] * share, len(rows)) + bias
        off = (1 / (1 + np.exp(-score)) - labels) / len(rows)
        g, gb = np.bincount(at, share * off[row], 2 * SPACE + 1) + 1e-6 * weight, off.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix_v = 1 - 0.9**step, 1 - 0.999**step
        weight -= rate * (m / fix) / (np.sqrt(v / fix_v) + 1e-8)
        bias -= rate * (mb / fix) / (math.sqrt(vb / fix_v) + 1e-8)
    return Scorer(weight.astype(np.float32), float(bias))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield pa.record_batch([pa.array(["".join(map(str, votes(x))) for x in part.column(0).to_pylist()], pa.string())], ["ballot"])


def _example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = _Slots()
    for batch in batches:
        for part in slices(batch):
            ballots, at, share = [], [], []
            for text in part.column(0).to_pylist():
                ballots.append("".join(map(str, votes(text))))
                where, n = np.unique(places(text, slots), return_counts=True)
                at.append(where.astype(np.int32))
                share.append((n / (n.sum() + CALM)).astype(np.float32))
            yield pa.record_batch([pa.array(ballots, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["ballot", "at", "share"])


def _table(ballots: list[str]) -> np.ndarray:
    return np.array([[int(v) for v in x] for x in ballots], np.int64).reshape(-1, len(LABELLERS))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """Accuracies from the votes on all documents, and the scorer from a sample of about ``sample`` different texts, chosen by hash.

    A null text votes as an empty one; equal texts count as often as they are there for the accuracies, and as one for the
    scorer. No rows give the model that knows nothing: every text is as likely good as bad.
    """
    counted = mapped(docs.select(docs[text].alias("text")), _vote, "ballot string").groupBy("ballot").agg(F.count("*").alias("n")).collect()  # at most 4 ** 8 rows
    counted.sort()
    model = estimate(_table([r["ballot"] for r in counted]), np.array([r["n"] for r in counted], float))
    rows = docs.select(F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("order", F.xxhash64(F.lit("sample"), "text"))
    got = mapped(sampled(rows, "order", sample).select("text"), _example, "ballot string, at array<int>, share array<float>").collect()
    got.sort(key=lambda r: (r["ballot"], r["at"], r["share"]))
    rows = [(np.array(r["at"], np.int64), np.array(r["share"])) for r in got]
    return model, fit_scorer(rows, model.posterior(_table([r["ballot"] for r in got])))


def scored(docs: DataFrame, model: LabelModel, scorer: Scorer, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, votes, posterior, score, kept) for each row: kept where the scorer gives at least ``least``.

    A null or empty text counts as one without words: its score is that of the bias alone, and it isn't kept. Repeated
    rows give repeated results; no rows give no rows. Other columns are left out, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                ballots = [votes(x) for x in texts]
                where = [places(x, slots) for x in texts]
                score = [scorer.of(x) for x in where]
                kept = [bool(len(x)) and s >= least for x, s in zip(where, score, strict=True)]
                belief = model.posterior(np.array(ballots, np.int64).reshape(-1, len(LABELLERS)))
                yield pa.record_batch([part.column(0), pa.array(["".join(map(str, x)) for x in ballots], pa.string()), pa.array(belief), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())], ["key", "votes", "posterior", "score", "kept"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return mapped(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, votes string, posterior double, score double, kept boolean").withColumnRenamed("key", key)
