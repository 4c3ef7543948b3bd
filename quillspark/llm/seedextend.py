"""Substring deduplication by seed and extend: repeats of at least ``window`` words in documents with a smaller id.

Seeds. Every run of ``seed`` words has a hash; among the ``window - seed + 1`` runs of a window the smallest is its
anchor (leftmost of equals), so equal windows have equal anchors at equal places, wherever they stand. Windows that follow
each other and share an anchor form a segment, about two for each ``window - seed`` words.

Joining. Segments meet on their anchors. Anchors that stand in one document only are left at once; they are most.
Segments with the same anchor and the same words are one class: each document but the smallest then repeats it whole.
Where an anchor has several classes, the matches differ in how far they reach: the smallest document of each class
extends the anchor by 0 to ``window - seed`` words to the left and the rest to the right, and two classes match there
if the fingerprints of these words are equal. Consecutive matches merge into maximal repeats, none under ``window`` words.
So no pairs of documents are made: a passage with n copies costs n rows, however it is surrounded.

Fingerprints have 64 bits beside the 64 of the anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, dropped, mapped, mix, slices, written

SEED = 12
WINDOW = 50
#: Windows are numbered within pieces of so many words, so that a place has 24 bits and a hash 40 in one integer.
PIECE = 1 << 23
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Polynomial fingerprints of word runs, from the words' 64-bit hashes; arithmetic is modulo 2**64."""

    def __init__(self, words: np.ndarray, base: np.uint64) -> None:
        n = len(words)
        inverse = pow(int(base), -1, 1 << 64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * _powers(base, n), out=self.sums[1:], dtype=np.uint64)
        self.back = _powers(np.uint64(inverse), n + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start])


def _hashes(text: str, known: WordHashes) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def segments_of(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(anchor, words, start, windows) of every segment of one document: hashes of the anchor and of all the segment's words with the anchor's place in them, its first window, and its number of windows."""
    out = []
    for first in range(0, max(1, len(words) - window + 1), PIECE):
        part = words[first : first + PIECE + window - 1]
        n = len(part) - window + 1
        if n <= 0:
            continue
        roll, roll_2 = Rolling(part, BASE), Rolling(part, BASE_2)
        seeds = roll.of(np.arange(len(part) - seed + 1), seed)
        ranked = (seeds & ~np.uint64(0xFFFFFF)) | np.arange(len(seeds), dtype=np.uint64)
        at = (_smallest(ranked, window - seed + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[start, n])
        place = at[start]
        body = roll_2.of(start, count + (window - 1)) ^ mix((place - start).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64))
        out.append((seeds[place], body, start + first, count))
    if not out:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _find_segments(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch):
                rows, found = [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    got = segments_of(_hashes(text, known), window, seed)
                    rows.append(np.full(len(got[0]), i))
                    found.append(got)
                if not sum(map(len, rows)):
                    continue
                at = pa.array(np.concatenate(rows))
                anchor, body, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["doc", "content", "anchor", "body", "start", "windows"],
                )

    return run


def _extend(window: int):
    """Each row is a document and the segments that it stands for; gives the fingerprint of every window of these."""

    def told(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["doc", "anchor", "body", "offset", "print"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, 32):
                out, rows = [], 0
                for doc, text, todo in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    roll = Rolling(_hashes(text, known), BASE_2)
                    anchor, body, start, count = (np.array([x[k] for x in todo], np.int64) for k in ("anchor", "body", "start", "windows"))
                    seg = np.repeat(np.arange(len(start)), count)
                    offset = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
                    out.append((np.full(len(seg), doc, np.int64), anchor[seg], body[seg], offset.astype(np.int32), roll.of(start[seg] + offset, window).view(np.int64)))
                    rows += len(seg)
                    if rows >= 50_000:  # windows are many more than segments: no more of them at once than this and one text's
                        yield told(out)
                        out, rows = [], 0
                if out:
                    yield told(out)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, content, spans): for each document with repeats, the places of all windows that start in a document with a smaller key too.

    spans: array of (start, mask): window start + i is repeated where bit i of mask is set. content is the hash of the
    text: rows that have the same key but not the same text are judged each by its own.
    """
    if not 0 < window - seed < 63:
        raise ValueError("window must exceed seed by 1 to 62 words")
    rows = docs.select(docs[key].cast("long").alias("doc"), F.xxhash64(docs[text]).alias("content"), docs[text].alias("text"))
    rows = rows.where("doc is not null and text is not null")
    found = written(mapped(rows, _find_segments(window, seed), "doc long, content long, anchor long, body long, start int, windows int"), "segments")
    shared = found.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("body").alias("b0"), F.max("body").alias("b1"))
    # written, so that both sides of the join are dealt out for it and a hot anchor's rows can be split
    shared = written(shared.where("lo < hi").select("anchor", F.expr("b0 <> b1").alias("differ")), "shared")
    met = written(found.join(shared, "anchor"), "met")
    dropped(found)
    classes = met.groupBy("anchor", "body").agg(F.min(F.struct("doc", "content", "start")).alias("first"), F.max("doc").alias("hi"), F.first("windows").alias("windows"), F.first("differ").alias("differ"))
    classes = written(classes.select("anchor", "body", "windows", "differ", "hi", F.col("first.doc").alias("lo"), F.col("first.content").alias("at"), F.col("first.start").alias("start")), "classes")
    todo = classes.where("differ").groupBy(F.col("lo").alias("doc"), F.col("at").alias("content")).agg(F.collect_list(F.struct("anchor", "body", "start", "windows")).alias("todo"))

    prints = written(mapped(rows.join(todo, ["doc", "content"]).select("doc", "text", "todo"), _extend(window), "doc long, anchor long, body long, offset int, print long"), "prints")
    best = written(prints.groupBy("anchor", "print").agg(F.min("doc").alias("best"), F.max("doc").alias("last")).where("best < last").drop("last"), "best")
    part = prints.join(best, ["anchor", "print"]).where("best < doc").groupBy("anchor", "body").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("part"))
    known = classes.join(written(part, "part"), ["anchor", "body"], "left").where("part is not null or lo < hi").select("anchor", "body", "lo", F.coalesce("part", F.lit(0)).alias("part"))
    known = written(known, "known")
    dropped(shared, classes, prints, best)
    hit = met.join(known, ["anchor", "body"]).select("doc", "content", "start", F.expr("case when doc > lo then shiftleft(1L, windows) - 1 else part end").alias("mask")).where("mask <> 0")
    return hit.groupBy("doc", "content").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))


def covered(n_words: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which words the repeated windows cover."""
    steps = np.zeros(n_words + 1, np.int64)
    if spans:
        start, mask = np.array([x["start"] for x in spans], np.int64), np.array([x["mask"] for x in spans], np.int64)
        bits = (mask[:, None] >> np.arange(63)) & 1 == 1
        at = (start[:, None] + np.arange(63))[bits]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _marked(docs: DataFrame, window: int, seed: int, key: str, text: str) -> DataFrame:
    """docs, its columns by number, with the spans of each row's repeats last."""
    found = repeats(docs, window, seed, key, text)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[key].cast("long").alias("id"), F.xxhash64(docs[text]).alias("hash"))
    marked = rows.join(found, (rows["id"] == found["doc"]) & (rows["hash"] == found["content"]), "left")
    return marked.select(*(F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), "spans")


def _kept(text: str | None, spans: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words that no repeated window covers."""
    words = (text or "").encode().split()
    if not spans:
        return len(words), words
    keep = ~covered(len(words), spans, window)
    return len(words), [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, n_words, n_removed, and the kept words joined by one space as ``text``, or with ``digest`` their SHA-256).

    One row for each row of docs. A null or empty text has no words and gives the empty text; a row with a null key is no
    source for others and loses nothing; of rows with one key none is a source for another; an empty table gives no rows. Texts of any length are compared whole.
    Other columns are left out, so their names can't clash.
    """
    marked = _marked(docs.select(key, text), window, seed, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                found = [_kept(*x, window) for x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                left = [b" ".join(words) for _, words in found]
                kept = [hashlib.sha256(x).hexdigest() if digest else x.decode() for x in left]
                yield pa.record_batch([part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n - len(w) for n, w in found], pa.int64()), pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept"])

    fields = f"key {docs.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept string"
    return mapped(marked, run, fields).withColumnsRenamed({"key": key, "kept": "kept_sha256" if digest else text})


def cleaned(docs: DataFrame, window: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """The rows of docs with their columns and without repeats in ``text``; ``count`` names a column that gets the new length.

    Texts that lose nothing stay as they are, to the character, and others are the kept words joined by one space. Rows
    that lose all their words go. Nulls, empty texts and repeated keys are as in without_repeats(); other columns are
    carried along whatever their names.
    """
    marked = _marked(docs, window, seed, key, text)
    at, spans_at, names = docs.columns.index(text), len(docs.columns), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                out = part.column(at).to_pylist()
                for i, spans in enumerate(part.column(spans_at).to_pylist()):
                    if spans:
                        _, words = _kept(out[i], spans, window)
                        out[i] = b" ".join(words).decode() if words else None
                lost = pa.array([bool(s) and x is None for s, x in zip(part.column(spans_at).to_pylist(), out, strict=True)], pa.bool_())
                part = part.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).select(range(spans_at))
                yield part.rename_columns(names).filter(pa.compute.invert(lost))

    rows = mapped(marked, run, docs.schema)
    return rows if count is None else rows.withColumn(count, F.length(text).cast(docs.schema[count].dataType)).select(docs.columns)
