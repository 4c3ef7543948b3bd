"""URL filter: listed rules first, gradient-boosted trees on lexical features for the rest.

Trees are trained here, on URLs that carry a label: length, depth, digit ratio, entropy, parameters, and what is known of
the host's suffix over all rows. Suffixes are counted in ``BUCKETS`` hashed buckets, so the table of their statistics has a
fixed size. Trees split histograms of quantile bins and take Newton steps on the logistic loss.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, sampled, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 4096
#: At most so many labelled URLs are learned from: those with the smallest hash.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, SMOOTH = 60, 3, 0.2, 32, 5.0
#: A suffix's share of blocked URLs counts so many URLs of the overall share with its own.
PRIOR = 10.0
#: A URL is blocked where the trees give at least this probability.
LEAST = 0.5
#: A learned URL has its suffix's share from the other folds, so that its own label isn't among its features.
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "longest_part", "is_https", "has_fragment", "first_length", "first_digit_ratio", "first_letters", "suffix_block_rate", "suffix_log_count")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(BUCKETS)).cast("int")


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host/path) that fits the host or one it is a subdomain of and starts the path; null if none does."""
    fits = []
    for rule in sorted(rules, key=lambda x: (-len(x), x)):
        domain, _, start = rule.partition("/")
        fits.append(F.when(((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """The features that follow from one URL alone; a first part of the path that is two letters, as of a language or a country, counts by its place in the alphabet."""
    url = url or ""
    n = len(url)
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    query = url.partition("?")[2].partition("#")[0]
    parts = re.split(r"[/.\-_?=&#]", url)
    first = path[1:].partition("/")[0]
    letters = (ord(first[0]) - 97) * 26 + ord(first[1]) - 97 if re.fullmatch("[a-z]{2}", first) else -1
    return [n, len(host), len(path), len([x for x in path.split("/") if x]), host.count(".") + 1 if host else 0, sum(map(str.isdigit, url)) / n if n else 0.0, entropy, query.count("&") + 1 if query else 0, url.count("-"), max(map(len, parts)), float(url[:8].lower() == "https://"), float("#" in url), len(first), sum(map(str.isdigit, first)) / len(first) if first else 0.0, letters]


class Tree(NamedTuple):
    """A complete tree: feature and threshold of each inner node in level order, values of the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(math.log2(len(self.value)))):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.threshold[at])
        return self.value[at - len(self.feature)]


class Forest(NamedTuple):
    base: float
    trees: tuple[Tree, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += RATE * tree.of(x)
        return 1 / (1 + np.exp(-score))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Places between values of the column, near its quantiles, and midway between the values on either side."""
    if not len(column):
        return np.zeros(0)
    values = np.unique(column)
    at = np.searchsorted(values, np.unique(np.quantile(column, np.arange(1, bins) / bins)), side="right")
    at = np.unique(at[at < len(values)])
    return (values[at - 1] + values[at]) / 2


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, watched: np.ndarray | None = None) -> Forest:
    """Trees for the probability of y = 1; the same for the same rows. Rows that are watched teach nothing: as many trees are kept as predict them best."""
    watched = np.zeros(len(y), bool) if watched is None or watched.all() else watched
    taught = ~watched
    cuts = [_cuts(col, bins) for col in x.T]
    codes = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    rate = (y[taught].sum() + 1) / (taught.sum() + 2)
    base = math.log(rate / (1 - rate))
    score, out, losses = np.full(len(y), base), [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        losses.append(float(np.logaddexp(0, np.where(y > 0, -score, score))[watched].sum()))
        grad, hess = (y - p) * taught, p * (1 - p) * taught
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                slot = (at - first) * (len(cut) + 1) + codes[:, f]
                g = np.bincount(slot, grad, width * (len(cut) + 1)).reshape(width, -1)
                h = np.bincount(slot, hess, width * (len(cut) + 1)).reshape(width, -1)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = cut[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - len(feature)
        value = np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + SMOOTH)
        out.append(Tree(feature, threshold, value))
        score += RATE * value[leaf]
    losses.append(float(np.logaddexp(0, np.where(y > 0, -score, score))[watched].sum()))
    return Forest(base, tuple(out[: int(np.argmin(losses)) if watched.any() else trees]))


class Suffixes(NamedTuple):
    """What is known of each suffix bucket. rate[0]: share of blocked URLs; rate[1 + fold]: the same without that fold; count: log of its number of URLs."""

    rate: np.ndarray
    count: np.ndarray


def suffixes(known: list[tuple[int, int, int, int, int]]) -> Suffixes:
    """From (bucket, fold, URLs, labelled, blocked); a suffix without labels is like all others."""
    labelled, blocked, n = (np.zeros((FOLDS, BUCKETS)) for _ in range(3))
    for bucket, fold, *counts in known:
        for table, x in zip((n, labelled, blocked), counts, strict=True):
            table[fold, bucket] += x
    rate = np.empty((1 + FOLDS, BUCKETS))
    for i in range(1 + FOLDS):
        use = np.arange(FOLDS) != i - 1
        overall = (blocked[use].sum() + 1) / (labelled[use].sum() + 2)
        rate[i] = (blocked[use].sum(0) + PRIOR * overall) / (labelled[use].sum(0) + PRIOR)
    return Suffixes(rate, np.log1p(n.sum(0)))


class Judge(NamedTuple):
    """What judged() learns."""

    suffixes: Suffixes
    forest: Forest

    def features(self, part: pa.RecordBatch, fold: np.ndarray | int = -1) -> np.ndarray:
        """From a batch (url, host, path, suffix, ...); with each row's fold, without what its fold tells of its suffix."""
        own = [lexical(*x) for x in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
        at = part.column(3).to_numpy()
        return np.column_stack([np.array(own, np.float64).reshape(-1, len(FEATURES) - 2), self.suffixes.rate[1 + fold, at], self.suffixes.count[at]])


def placed(pages: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url") -> DataFrame:
    """(url, host, path, suffix, key, rule, listed, order, fold) of each row."""
    rows = pages.select(pages[url].alias("url"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), pages[key].alias("key"))
    rows = rows.withColumn("suffix", suffix_of(F.col("host"))).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    listed = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair)) if rules else F.lit(None).cast("map<string,string>")
    rows = rows.withColumn("listed", listed[F.col("rule")]).withColumn("order", F.xxhash64(F.lit("sample"), "url"))
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int"))  # equal URLs are in one fold


def learned(rows: DataFrame, sample: int = SAMPLE) -> Judge:
    """From the rows of placed() with a label in ``listed``; the suffixes' numbers count all rows."""
    counts = (F.count("*").alias("n"), F.count("listed").alias("labelled"), F.count_if(F.col("listed") == "block").alias("blocked"))
    known = suffixes([tuple(r) for r in rows.groupBy("suffix", "fold").agg(*counts).collect()])  # at most BUCKETS * FOLDS rows
    bare = Judge(known, Forest(-20.0, ()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048):
                yield pa.record_batch([pa.array(list(bare.features(part, part.column(4).to_numpy())), pa.list_(pa.float64())), part.column(5), part.column(4)], ["x", "blocked", "fold"])

    labelled = rows.where("listed is not null").select("url", "host", "path", "suffix", "fold", (F.col("listed") == "block").alias("blocked"), "order")
    got = mapped(sampled(labelled, "order", sample).drop("order"), features, "x array<double>, blocked boolean, fold int").collect()
    if not got:
        return bare
    got.sort(key=lambda r: (r["x"], r["blocked"], r["fold"]))
    x, y, fold = (np.array([r[c] for r in got], np.float64) for c in ("x", "blocked", "fold"))
    return Judge(known, boost(x, y, watched=fold == FOLDS - 1))


def judged(pages: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url", sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """(key, host, path, rule, verdict, score) for each row: the rule's verdict where one fits, else that of the trees.

    rules: 'host/path' -> 'allow' or 'block'. URLs that a rule fits are the labelled ones; score is the trees' probability
    of 'block', and ``least`` and more blocks. A null URL and one without '://' have an empty host and path and are judged by the trees. Where no URL
    has a label, the trees have nothing to learn and allow. Equal URLs are one example; repeated rows give repeated results; no rows give no
    rows. Very long URLs are read whole; other columns are left out, so their names can't clash.
    """
    rows = placed(pages, rules, key, url)
    judge = learned(rows, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048):
                score = judge.forest.probability(judge.features(part))
                verdict = [x or ("block" if s >= least else "allow") for x, s in zip(part.column(6).to_pylist(), score.tolist(), strict=True)]
                yield pa.record_batch([part.column(4), part.column(1), part.column(2), part.column(5), pa.array(verdict, pa.string()), pa.array(score)], ["key", "host", "path", "rule", "verdict", "score"])

    fields = f"key {rows.schema['key'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double"
    return mapped(rows.select("url", "host", "path", "suffix", "key", "rule", "listed"), run, fields).withColumnRenamed("key", key)
