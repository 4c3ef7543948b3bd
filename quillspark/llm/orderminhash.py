"""Near duplicates by order MinHash: sketches that keep the order of sampled word runs, verified by banded alignment.

A text's words (lower case, without the marks around them) give runs of five words, each labelled with its occurrence in
the text; short runs do so too, and the words of a short text. Each of some hash functions (``TABLES`` and so on) takes
the two smallest labelled runs, of single words the five smallest, and keeps them in text order; texts that agree on
these are candidates. Texts of up to nine words, which one edit may part at most, have keys that find each other for
certain. Exact copies are one text from the start.

Candidates meet three times, and texts that an alignment links are one part from then on. First every text of a bucket
meets the one with the smallest id. Then, where a bucket still holds several parts, those outside its largest part meet
one text of that part, another one in each bucket. What both meetings leave is looked at exhaustively: every two texts of
different parts that share a bucket meet in one bucket that both have, whole blocks of texts at once, where the words
that they have in common, order aside, are counted exactly, and all pairs that can reach the threshold by these are
aligned, the nearest first, until their parts are one. Texts of the largest part are only set against the others, never
against each other, and in a hot bucket only texts of like length meet; so a bucket of one large part and few others
costs its size, and only a bucket of many texts that are all different is compared in all pairs of blocks.

In the first two meetings texts are joined for alignment only if 128 MinHash values of their labelled words, of two bits
each, differ in no more places than five standard deviations beyond what is expected at the threshold allow.

Similarity is 1 - edits / words of the longer text, from an alignment of words in a band that is widened until the number
of edits is certain or exceeds what the threshold allows. Long texts are first held against two bounds in linear time:
word runs that must be found nearby, and an alignment along runs that both have once.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, components, dropped, mapped, mix, slices, whole_groups, written

WORDS = 5
THRESHOLD = 0.8
TABLES = 16
#: Tables of shorter runs, which edits at even distances leave whole; and, for texts of up to SHORT words, of WORD_MINIMA single words each.
SHORT_WORDS, SHORT_TABLES = 3, 48
SHORT, WORD_TABLES, WORD_MINIMA = 128, 40, 5
#: Texts of up to so many words link by one edit at most, so they have keys that find every one; tables of single words begin a little below.
TINY, WORDS_FROM = 9, 8
MULTIPLIERS = (mix(np.arange(1, 1 + 4096, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Texts of a bucket are dealt into blocks of about so many, of about so many words in all; blocks meet in pairs.
BLOCK = 1024
BLOCK_WORDS = 1 << 20
#: Pairs of texts with more words than this, beside what both begin and end with, are held against bounds before they are aligned.
LONG = 4096
BAG_MULTIPLIERS = (mix(np.arange(5000, 5128, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Marks that don't count at a word's ends.
MARKS = b".,;:!?\"'()[]{}<>|#*$%&-_"


class _Plain(WordHashes):
    @staticmethod
    def shape(word: bytes) -> bytes:
        return word.strip(MARKS) or word


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    words = text.lower().encode().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def labelled_runs(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """A hash for each run of k words, together with the number of its earlier occurrences if there are any; a shorter text is one run."""
    k = min(k, len(words))
    runs = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        runs = mix(runs + words[i : len(words) - k + 1 + i])
    ranked = np.sort(runs)
    if (ranked[1:] != ranked[:-1]).all():
        return runs
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    nth = np.arange(len(runs)) - np.repeat(first, np.diff(np.r_[first, len(runs)]))
    again = order[nth > 0]  # a first occurrence keeps its hash, so that texts with and without repeats agree on it
    runs[again] = mix(runs[again] + nth[nth > 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return runs


def sketch(words: np.ndarray, tables: int, k: int = WORDS, minima: int = 2) -> np.ndarray:
    """For each table, a hash of its smallest labelled runs, so many, in text order."""
    runs = labelled_runs(words, k)
    short = (runs >> np.uint64(32)).astype(np.uint32)
    out = np.empty(tables, np.uint64)
    at_once = max(1, (1 << 17) // len(runs))
    for t in range(0, tables, at_once):
        ranks = short[None, :] * MULTIPLIERS[t : min(t + at_once, tables), None]
        if minima == 2:
            a = ranks.argmin(1)
            ranks[np.arange(len(ranks)), a] = 0xFFFFFFFF
            b = ranks.argmin(1)
            first, second = runs[np.minimum(a, b)], runs[np.maximum(a, b)]
            out[t : t + len(ranks)] = mix(first) ^ (second << np.uint64(1) | second >> np.uint64(63))
            continue
        taken = np.sort(np.argpartition(ranks, minima - 1, axis=1)[:, :minima], axis=1) if len(runs) > minima else np.arange(len(runs))[None, :].repeat(len(ranks), 0)
        key = np.zeros(len(ranks), np.uint64)
        for column in taken.T:
            key = mix(key + runs[column])
        out[t : t + len(ranks)] = key
    return mix(out + np.arange(tables, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def one_edit_keys(words: np.ndarray) -> np.ndarray:
    """Hashes of a text of few words and of what is left without each of them: two texts share one if one edit or none makes them equal, and else hardly ever."""
    n = len(words)
    kept = np.ones((n + 1, n), bool)
    kept[np.arange(n), np.arange(n)] = False
    key = np.zeros(n + 1, np.uint64)
    for i in range(n):
        key = np.where(kept[:, i], mix(key * np.uint64(3) + words[i]), key)
    return mix(key + np.uint64(3))


def bag(words: np.ndarray) -> np.ndarray:
    """Two bits of each of 128 MinHash values of the occurrence-labelled words, in four integers."""
    labelled = (labelled_runs(words, 1) >> np.uint64(32)).astype(np.uint32)
    low = np.full(128, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(labelled), 1024):
        np.minimum(low, (labelled[at : at + 1024, None] * BAG_MULTIPLIERS).min(0), out=low)
    pairs = (low & np.uint32(3)).astype(np.uint64).reshape(4, 32)
    return (pairs << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(1, dtype=np.uint64)


def bags_differ(a: str, b: str) -> Column:
    """In how many of the 128 places two bags differ."""
    ones = [F.expr(f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & 6148914691236517205L)") for i in range(4)]
    return ones[0] + ones[1] + ones[2] + ones[3]


def bags_may_differ(threshold: float) -> int:
    common = threshold / (2 - threshold)
    differ = 0.75 * (1 - common)
    return math.floor(128 * differ + 5 * math.sqrt(128 * differ * (1 - differ)))


def buckets_of(words: np.ndarray, tables: int = TABLES, k: int = WORDS, short_tables: int = SHORT_TABLES) -> np.ndarray:
    """The sketches by runs of k words, by short runs, and of a short text by words, with a very short one's keys; without ``short_tables`` the first only.

    Frequent words make up a table of two minima in a fixed share of all short texts, whatever they say; five in one order
    hardly ever do, and keys of all words but one never.
    """
    found = [sketch(words, tables, k)]
    if short_tables:
        found.append(mix(sketch(words, short_tables, SHORT_WORDS) + np.uint64(1)))
        if WORDS_FROM <= len(words) <= SHORT:
            found.append(mix(sketch(words, WORD_TABLES, 1, WORD_MINIMA) + np.uint64(2)))
        if len(words) <= TINY:
            found.append(one_edit_keys(words))
    return np.concatenate(found)


def _sketches(tables: int, k: int, short_tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Plain()
        for batch in batches:
            for part in slices(batch):
                ids, keys, n, bags = [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = word_hashes(text, known)
                    if len(words):
                        ids.append(doc)
                        n.append(len(words))
                        keys.append(buckets_of(words, tables, k, short_tables).view(np.int64))
                        bags.append(bag(words).view(np.int64))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(bags, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["doc", "n", "bag", "buckets"])

    return run


def _shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection as multisets."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[ia], cb[ib]).sum())


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def _runs_nearby(a: np.ndarray, b: np.ndarray, k: int, reach: int) -> int:
    """How many runs of k words of a are in b too, at most ``reach`` places from where they are in a."""
    keys = []
    for x in (a, b):
        run = np.zeros(len(x) - k + 1, np.uint64)
        for i in range(k):
            run = mix(run + x[i : len(x) - k + 1 + i])
        keys.append(run)
    n, span = len(keys[0]), max(map(len, keys)) + 1
    kind = np.unique(np.concatenate(keys), return_inverse=True)[1] * span
    there = np.sort(kind[n:] + np.arange(len(keys[1])))
    place = np.arange(n)
    at = np.searchsorted(there, kind[:n] + np.maximum(place - reach, 0))
    return int((there[np.minimum(at, len(there) - 1)] <= kind[:n] + np.minimum(place + reach, span - 1))[at < len(there)].sum())


def _too_far(a: np.ndarray, b: np.ndarray, allowed: int) -> bool:
    """Whether a and b differ by more than ``allowed`` edits for certain: an edit breaks k runs of k words at most, and moves none further than one place."""
    return any(_runs_nearby(a, b, k, allowed) < len(a) - k + 1 - k * allowed for k in (2, 3, 4) if min(len(a), len(b)) >= k)


def _edits_by_anchors(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """Edits of one alignment, so never fewer than the least number: along the longest chain of runs of k words that each of a and b has once."""
    once = []
    for x in (a, b):
        run = np.zeros(max(0, len(x) - k + 1), np.uint64)
        for i in range(k):
            run = mix(run + x[i : len(x) - k + 1 + i])
        value, place, count = np.unique(run, return_index=True, return_counts=True)
        once.append((value[count == 1], place[count == 1]))
    _, ia, ib = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    pa, pb = once[0][1][ia], once[1][1][ib]
    order = np.argsort(pa)
    pa, pb = pa[order], pb[order]
    ends, top, before = [], [], np.full(len(pb), -1)
    for i, x in enumerate(pb.tolist()):
        j = bisect_left(ends, x)
        before[i] = top[j - 1] if j else -1
        ends[j : j + 1], top[j : j + 1] = [x], [i]
    chain = []
    i = top[-1] if top else -1
    while i >= 0:
        chain.append(i)
        i = int(before[i])
    chain = np.array(chain[::-1], np.int64)
    pa, pb = np.r_[pa[chain], len(a)], np.r_[pb[chain], len(b)]
    met = np.minimum(k, np.minimum(np.diff(pa), np.diff(pb)))
    sa, sb = np.r_[0, pa[:-1] + met], np.r_[0, pb[:-1] + met]  # the gaps: from here to the next anchor
    la, lb = pa - sa, pb - sb
    steps = np.r_[0, np.cumsum(la)]
    place = np.arange(steps[-1]) - np.repeat(steps[:-1], la)
    even = np.repeat(la == lb, la)
    same = np.zeros(len(place), bool)
    same[even] = a[(np.repeat(sa, la) + place)[even]] == b[(np.repeat(sb, la) + place)[even]]
    return int(np.maximum(la, lb).sum() - same.sum())


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], half: int) -> np.ndarray:
    """Edits of each pair, all pairs at once, along paths at most ``half`` off the diagonal; exact where the result is at most ``half``."""
    n, m = (np.array([len(x[i]) for x in pairs]) for i in (0, 1))
    rows, width = int(n.max()), 2 * half + 1
    left = np.zeros((len(pairs), rows), np.uint64)
    right = np.zeros((len(pairs), rows + 2 * half + 2), np.uint64)
    apart = np.ones((len(pairs), rows + 2 * half + 2), bool)  # places without a word match nothing
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = a
        b = b[: rows + half + 1]
        right[i, half : half + len(b)] = b
        apart[i, half : half + len(b)] = False
    offset = np.arange(-half, half + 1, dtype=np.int32)
    big = np.int32(1 << 28)
    now = np.where(offset >= 0, offset, big).astype(np.int32)[None, :].repeat(len(pairs), 0)
    out = np.full(len(pairs), int(big), np.int64)
    at = np.clip(m - n + half, 0, width - 1)
    inside = np.abs(m - n) <= half
    ends = np.argsort(n, kind="stable")
    done = int((n == 0).sum())
    for i in ends[:done]:
        out[i] = now[i, at[i]]
    for r in range(1, rows + 1):
        step = now + ((left[:, r - 1, None] != right[:, r - 1 : r - 1 + width]) | apart[:, r - 1 : r - 1 + width])
        step[:, :-1] = np.minimum(step[:, :-1], now[:, 1:] + 1)
        if r <= half:
            step[:, : half - r] = big
            step[:, half - r] = r
        now = np.minimum.accumulate(step - offset, axis=1) + offset
        while done < len(ends) and n[ends[done]] == r:
            out[ends[done]] = now[ends[done], at[ends[done]]]
            done += 1
    out[~inside] = int(big)
    return out


def similarities(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float, exact: bool = True) -> np.ndarray:
    """Similarity of each pair of word arrays; -1 where it is under the threshold.

    Edits along a narrow band are never fewer than without it. Unless ``exact``, a pair that reaches the threshold within
    a band is done, and its similarity is a lower bound; which pairs reach the threshold is the same either way. A pair of
    long texts that no bound decides takes time by the square of its length.
    """
    out = np.full(len(pairs), -1.0)
    todo = []
    for i, (a, b) in enumerate(pairs):
        most = max(len(a), len(b))
        allowed = int((1 - threshold) * most + 1e-9)
        if abs(len(a) - len(b)) > allowed or most - _shared_words(a, b) > allowed:
            continue
        ta, tb = _trim(a, b)
        if not len(ta) or not len(tb):
            out[i] = 1 - max(len(ta), len(tb)) / most
            continue
        if min(len(ta), len(tb)) > LONG:
            if _too_far(ta, tb, allowed):
                continue
            if not exact and (edits := min(_edits_by_anchors(ta, tb, k) for k in (3, 4))) <= allowed:
                out[i] = 1 - edits / most
                continue
        todo.append((i, ta, tb, allowed, most))
    half = 32 if exact else 8
    while todo:
        todo.sort(key=lambda x: len(x[1]))
        left, at = [], 0
        while at < len(todo):
            upto = at + 1
            while upto < len(todo) and (upto - at) < 64 and (upto - at + 1) * (len(todo[upto][1]) + 4 * half) < 400_000:
                upto += 1
            group = todo[at:upto]
            for x, edits in zip(group, banded([(x[1], x[2]) for x in group], half).tolist(), strict=True):
                i, _, _, allowed, most = x
                if edits <= (min(half, allowed) if exact else allowed):
                    out[i] = 1 - edits / most
                elif edits > half and half < allowed:
                    left.append(x)
            at = upto
        todo, half = left, half * 4
    return out


def _to_meet(own: slice, c: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one (bucket, band, i, j) that have to be looked at: texts of different parts whose lengths allow a link, in the smallest bucket that both have and the band of the longer, so each pair once."""
    part, n, buckets, block, size = (c[k][own] for k in ("part", "n", "buckets", "block", "size"))
    none = np.zeros(0, np.int64)
    if (part == part[0]).all():
        return none, none
    most = np.maximum(n[:, None], n[None, :])
    fit = (part[:, None] != part[None, :]) & (most - np.minimum(n[:, None], n[None, :]) <= (1 - threshold) * most + 1e-9)
    if c["i"][own.start] != c["j"][own.start]:
        fit &= block[:, None] != block[None, :]
    at_home = size == c["band"][own.start]
    fit &= at_home[:, None] | at_home[None, :]
    x, y = (at.astype(np.int32) for at in np.nonzero(np.triu(fit)))
    del most, fit
    last = np.iinfo(np.int64).max
    once = [none == 0]
    for at in range(0, len(x), 8_000):  # so many pairs of bucket lists take about 15 MB
        ku, kv = buckets[x[at : at + 8_000]], buckets[y[at : at + 8_000]]
        least = np.where(ku == kv, ku, last).min(1, initial=last)
        tiny = np.flatnonzero((n[x[at : at + 8_000]] <= TINY) & (n[y[at : at + 8_000]] <= TINY))
        for p in tiny.tolist():  # their keys stand in no fixed places
            least[p] = np.intersect1d(ku[p], kv[p]).min(initial=last)
        once.append(least == c["bucket"][own.start])
    kept = np.concatenate(once)
    return x[kept], y[kept]


_GROUP = ("bucket", "band", "i", "j")
_PLACE = (*_GROUP, "block", "size", "doc", "n", "part")
_SEATS = "bucket long, band int, i int, j int, block int, size int, doc long, n int, part long, buckets array<long>"


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    c = {k: table.column(k).to_numpy() for k in _PLACE}
    lists = table.column("buckets").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy()
    c["buckets"] = np.repeat(np.iinfo(np.int64).min + np.arange(table.num_rows)[:, None], size.max(initial=0), 1)  # a shorter list goes on with what no other has
    c["buckets"][np.arange(size.max(initial=0)) < size[:, None]] = lists.flatten().to_numpy()
    return c


def _seats(threshold: float):
    """Rows of one (bucket, band, i, j) come together; gives those that have a pair to be looked at there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_groups(batches, _GROUP):
            c = _columns(table)
            found = [np.unique(np.concatenate(_to_meet(slice(s, e), c, threshold))) + s for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s > 1]
            if found and len(at := np.concatenate(found)):
                yield from table.take(pa.array(at)).to_batches(max_chunksize=4096)

    return run


def _common_words(words: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Size of the intersection as multisets of texts x and y; x is in order."""
    used, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    labelled = [labelled_runs(words[i], 1) for i in used.tolist()]
    starts = np.r_[0, np.cumsum([len(w) for w in labelled])]
    known, flat = np.unique(np.concatenate(labelled), return_inverse=True)
    mark = np.zeros(len(known), bool)
    out = np.empty(len(x), np.int64)
    edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]).tolist()
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        own = flat[starts[place[s]] : starts[place[s] + 1]]
        mark[own] = True
        out[s:e] = np.add.reduceat(mark[flat], starts[:-1], dtype=np.int64)[place[len(x) + s : len(x) + e]]
        mark[own] = False
    return out


def joined(docs: np.ndarray, part: np.ndarray, words: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between texts of different parts. Of the pairs (x, y), x in order, every one is aligned whose words, order aside, allow a link, unless links found before have made its parts one."""
    n = np.array([len(w) for w in words])
    most = np.maximum(n[x], n[y])
    common = _common_words(words, x, y)
    order = np.argsort(-common / most, kind="stable")
    order = order[(most - common <= (1 - threshold) * most + 1e-9)[order]]
    x, y, part, links, take = x[order], y[order], part.copy(), [], 4
    while len(x):
        p, q = np.minimum(part[x], part[y]), np.maximum(part[x], part[y])
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        by = np.lexsort((np.arange(len(x)), q, p))  # of each two parts the pairs with most words in common first
        first = np.flatnonzero(np.r_[True, (p[by][1:] != p[by][:-1]) | (q[by][1:] != q[by][:-1])][: len(by)])
        now = np.zeros(len(x), bool)
        now[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)])) < take
        u, v = x[now].tolist(), y[now].tolist()
        for at in range(0, len(u), 512):
            a, b = u[at : at + 512], v[at : at + 512]
            for i, j, s in zip(a, b, similarities([(words[i], words[j]) for i, j in zip(a, b, strict=True)], threshold, exact=False).tolist(), strict=True):
                if s >= 0 and part[i] != part[j]:
                    links.append((min(docs[i], docs[j]), max(docs[i], docs[j])))
                    part[part == part[j]] = part[i]
        x, y, take = x[~now], y[~now], take * 4
    return links


def _links(threshold: float):
    """Rows of one (bucket, band, i, j), with their words, come together; gives links that make parts one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_groups(batches, _GROUP):
            c, found = _columns(table), []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                x, y = _to_meet(slice(s, e), c, threshold)
                if len(x):
                    words = [np.frombuffer(w, np.uint64) for w in table.column("words").slice(s, e - s).to_pylist()]
                    found += joined(c["doc"][s:e], c["part"][s:e], words, x, y, threshold)
            if found:
                yield pa.record_batch([pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Plain()
    for batch in batches:
        for part in slices(batch):
            yield pa.record_batch([part.column(0), pa.array([word_hashes(x, known).tobytes() for x in part.column(1).to_pylist()], pa.binary())], ["doc", "words"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Plain()
        for batch in batches:
            for part in slices(batch, 512):
                pairs = [(word_hashes(x, known), word_hashes(y, known)) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                found = pa.array(similarities(pairs, threshold, exact=False))
                yield pa.record_batch([part.column(0), part.column(1), found], ["a", "b", "similarity"])

    return run


def aligned(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose texts reach the threshold. pairs: (a, b); texts: (doc, text)."""
    left = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    return mapped(both.select("a", "b", "text_a", "text_b"), _verify(threshold), "a long, b long, similarity double").where("similarity >= 0")


def _content(text: Column) -> Column:
    """128 bits of the exact text."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit("salt"), text).alias("y"))


def _linked(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts an alignment links."""
    bags_a, bags_b = (sketches.select(F.col("doc").alias(x), F.col("bag").alias(f"bag_{x}")) for x in "ab")
    near = pairs.distinct().join(bags_b, "b").join(bags_a, "a").where(bags_differ("bag_a", "bag_b") <= bags_may_differ(threshold))
    near = written(near.select("a", "b"), "pairs")
    links = written(aligned(near, texts, threshold).select("a", "b"), "links")
    dropped(near)
    return links


def _in_parts(met: DataFrame, parts: DataFrame) -> DataFrame:
    """met with the part of each text: the smallest one that it is linked with so far."""
    return met.join(parts.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("part", F.coalesce("component", "doc")).drop("component")


def _dealt(members: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """Members (bucket, doc, n, part) of those of so many buckets that have several parts, with band, size, block, i and j, each as often as needed.

    Two texts of different parts meet in one (bucket, band, i, j) at least, if their lengths allow a link. A bucket of up
    to a block is one group. In a larger one a text stands in the band of its length and in the next; bands are wide
    enough for texts that may link to be in the same or in neighbouring ones. A band's texts of the bucket's largest
    part and the others are dealt into blocks apart; the others' blocks meet all blocks, those of the largest part meet
    the others' only.
    """
    by_part = members.groupBy("bucket", "part").agg(F.count("*").alias("count"), F.sum("n").alias("words"))
    many = by_part.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("count").alias("count"), F.sum("words").alias("words"), F.max_by("part", F.struct("count", "part")).alias("largest"))
    # written, so that both sides of the join are dealt out for it and a hot bucket's rows can be split
    many = many.where("parts > 1 and count > 2").select("bucket", "largest", ((F.col("count") > BLOCK) | (F.col("words") > BLOCK_WORDS)).alias("hot"))
    many = written(many, "many", buckets)
    rows = members.join(many, "bucket").withColumn("large", F.col("part") == F.col("largest")).drop("largest")
    size = F.when(F.col("hot"), F.floor(F.log("n") / F.lit(math.log(1.01 / threshold)))).otherwise(0).cast("int")
    rows = rows.withColumn("size", size).withColumn("band", F.explode(F.when(F.col("hot"), F.array(F.col("size"), F.col("size") + 1)).otherwise(F.array(F.lit(0)))))
    blocks = lambda own: F.ceil(F.greatest(F.count_if(own) / BLOCK, F.sum(F.when(own, F.col("n"))) / BLOCK_WORDS))
    own_band = F.col("size") == F.col("band")
    at_home = (F.count_if(own_band & ~F.col("large")).alias("home_others"), F.count_if(own_band & F.col("large")).alias("home_larges"))
    banded_ = rows.where("hot").groupBy("bucket", "band").agg(blocks(~F.col("large")).alias("others"), F.coalesce(blocks(F.col("large")), F.lit(0)).alias("larges"), *at_home)
    banded_ = written(banded_.where("others > 0"), "bands", many.where("hot").count() * 20)
    cold = rows.where("not hot").withColumns({"block": F.lit(0), "other": F.lit(0)})
    # of two texts that meet in a band one is at home there and one isn't of the largest part: who finds no such text stays away
    hot = rows.where("hot").join(banded_, ["bucket", "band"]).where(own_band | (F.col("home_others") > 0) | (~F.col("large") & (F.col("home_larges") > 0)))
    hashed = F.xxhash64("doc")
    hot = hot.withColumn("block", F.when(F.col("large"), F.col("others") + F.pmod(hashed, F.greatest("larges", F.lit(1)))).otherwise(F.pmod(hashed, F.col("others"))))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("large"), F.col("others")).otherwise(F.col("others") + F.col("larges")) - 1)))
    columns = ["bucket", "band", "size", "doc", "n", "part", *(F.col(c).cast("int").alias(c) for c in ("block", "other"))]
    rows = cold.select(*columns).union(hot.select(*columns))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tables: int = TABLES, k: int = WORDS, short_tables: int = SHORT_TABLES) -> DataFrame:
    """(key, content, class_id) of every row: class_id is the smallest key of the texts that are linked to its own, over any number of links.

    Texts link if they are equal or their similarity reaches the threshold. A null text links with nothing; a text
    without a word links with equal texts only. A row with a null key is nobody's representative, and its class_id is null. No rows give no rows. Other
    columns are left out, so their names can't clash.
    content is the hash by which rows with one key but different texts are told apart; such texts are not told apart as ends of links.
    """
    rows = docs.select(docs[key].cast("long").alias("doc"), docs[text].alias("text")).withColumn("content", _content(F.col("text")))
    exact = written(rows.where("doc is not null and text is not null").groupBy("content").agg(F.min("doc").alias("first")), "exact")
    texts = rows.where("text is not null").join(exact.select("content", F.col("first").alias("doc")), ["doc", "content"]).select("doc", "text")
    sketches = written(mapped(texts, _sketches(tables, k, short_tables), "doc long, n int, bag array<long>, buckets array<long>"), "sketches")
    buckets = sketches.select("doc", "n", F.explode(F.array_distinct("buckets")).alias("bucket"))
    # written, so that both sides of the join are dealt out for it and a hot bucket's rows can be split
    shared = written(buckets.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("bucket", "lo"), "shared")
    met = written(buckets.join(shared, "bucket"), "met")
    first = met.where("lo < doc").select(F.col("lo").alias("a"), F.col("doc").alias("b")).distinct()
    texts = written(texts.join(met.select("doc").distinct(), "doc").groupBy("doc").agg(F.min("text").alias("text")), "texts")
    links = _linked(met.where("lo < doc").select(F.col("lo").alias("a"), F.col("doc").alias("b")), sketches, texts, threshold)
    n_links, n_shared = links.count(), shared.count()
    parts = written(components(links), "parts", 2 * n_links)
    members = _in_parts(met, parts)
    by_part = members.groupBy("bucket", "part").agg(F.count("*").alias("count"), F.min_by("doc", F.xxhash64("doc", "bucket")).alias("one"))
    many = by_part.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by(F.struct("part", "one"), F.struct("count", "part")).alias("largest"))
    many = written(many.where("parts > 1").select("bucket", F.col("largest.part").alias("largest"), F.col("largest.one").alias("one")), "many", n_shared)
    again = members.join(many, "bucket").where("part <> largest and one <> lo and doc <> lo")
    more = _linked(again.select(F.least("one", "doc").alias("a"), F.greatest("one", "doc").alias("b")), sketches, texts, threshold)
    n_links += more.count()
    parts_now = written(components(links.union(more)), "parts", 2 * n_links)
    dealt = _dealt(_in_parts(met.select("bucket", "doc", "n"), parts_now), threshold, n_shared).join(sketches.select("doc", "n", "buckets"), ["doc", "n"])
    dealt = dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP).select(*_PLACE, "buckets")
    seats = written(mapped(dealt, _seats(threshold), _SEATS), "seats")
    words = mapped(texts.join(seats.select("doc").distinct(), "doc", "left_semi"), _words, "doc long, words binary")
    seated = seats.join(words, "doc").repartition(*_GROUP).sortWithinPartitions(*_GROUP).select(*_PLACE, "buckets", "words")
    new = written(mapped(seated, _links(threshold), "a long, b long"), "links")
    dropped(sketches, shared, met, texts, parts, many, seats, parts_now)
    parts = written(components(links.union(more).union(new)), "parts", 2 * (n_links + new.count()))
    dropped(links, more, new)
    found = exact.join(parts.select(F.col("node").alias("first"), "component"), "first", "left").select("content", F.coalesce("component", "first").alias("class_id"))
    found = written(found, "classes")
    dropped(exact, parts)
    named = rows.select("doc", "content", F.expr("text is null").alias("void")).join(found, "content", "left")
    return named.select(F.col("doc").alias(key), "content", F.expr("case when doc is null then null when void then doc else class_id end").alias("class_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs without near duplicates: of each class the row with the smallest key, with all its columns, once.

    Rows with a null key or text stay as they are. Other columns are carried along whatever their names.
    """
    kept = classes(docs, key, text, **how).where(F.col(key) == F.col("class_id")).select(F.col(key).cast("long").alias("id"), "content").distinct()
    void = docs[key].isNull() | docs[text].isNull()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[key].cast("long").alias("id"), _content(docs[text]).alias("content"), void.alias("void"))
    nth = F.row_number().over(Window.partitionBy("id", "content").orderBy("id"))
    found = rows.where("not void").join(kept, ["id", "content"]).withColumn("nth", nth).where("nth = 1")
    return found.select("row.*").union(rows.where("void").select("row.*"))
