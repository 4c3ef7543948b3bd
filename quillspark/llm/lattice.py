"""Near-duplicate embeddings by lattice hashing, verified by cosine in double precision.

Vectors of length 1 are projected at random to 16 dimensions or more, 8 for each part, and each part is decoded to the nearest point of
the E8 lattice. A table's cell is the tuple of points; a vector also stands in the cells that have its second nearest
point in some or all parts. Vectors that share a cell are compared.

With the scale 3.5 and two parts, two vectors at cosine 0.901 share a cell of one table with probability 0.45, at random
0.0009; more parts divide the latter by about 50 each, so that the comparisons of a vector don't grow with their number,
and need more tables: see ``SETTINGS``.

Equal vectors are one vector with a count. A cell with more than ``BLOCK`` vectors is cut into blocks, and every pair of
blocks is a task's group of its own: a hot cell never meets in one task. Blocks compare by one matrix product and emit one
row for each vector - how many it links with, and the smallest vector of its part of the block - so never the pairs. A pair
that shares several cells counts in the smallest only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, in_block_pairs, mapped, mix, whole_groups, written

THRESHOLD = 0.9
#: Up to so many different vectors: parts of a cell, and tables. Recall at cosine 0.901 was measured as 0.998, 0.996 and 1.0.
SETTINGS = ((1_000_000, 2, 10), (50_000_000, 3, 20), (math.inf, 4, 36))
SCALE = 3.5
BLOCK = 256


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1) in two places, and halves with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _even_integers(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum: round, and where the sum is odd round the least certain one the other way."""
    out = np.rint(x)
    off = x - out
    worst = np.abs(off).argmax(1)
    odd = np.flatnonzero(out.sum(1) % 2 != 0)
    out[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
    return out


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row."""
    whole, half = _even_integers(x), _even_integers(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def second(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The nearest other point: the neighbour in the direction of the rest."""
    return point + ROOTS[((x - point) @ ROOTS.T).argmax(1)]


def projections(dim: int, tables: int, halves: int, scale: float, seed: int) -> np.ndarray:
    """For each table and half a matrix of dim x 8 whose columns are orthogonal, where dim allows."""
    rng = np.random.default_rng([seed, dim])
    out = rng.normal(size=(tables, halves, dim, 8))
    if dim >= 8 * halves:
        for t in range(tables):
            full, _ = np.linalg.qr(out[t].transpose(1, 0, 2).reshape(dim, 8 * halves))
            out[t] = full.reshape(dim, halves, 8).transpose(1, 0, 2) * np.sqrt(dim)
    return out * (scale / 8.0)


def cells(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For each vector its cells, 2 ** halves for each table: the table's number above 32 bits of hash."""
    tables, halves = planes.shape[:2]
    n = len(vectors)
    out = np.empty((n, tables, 2**halves), np.uint64)
    spread = mix(np.arange(1, 9, dtype=np.uint64))
    for t in range(tables):
        options = []
        for h in range(halves):
            x = vectors @ planes[t, h]
            first = nearest(x)
            options.append([mix(((p * 2).astype(np.int64).view(np.uint64) * spread).sum(1, dtype=np.uint64) + np.uint64(h)) for p in (first, second(x, first))])
        for i, pick in enumerate(itertools.product(*options)):
            total = np.zeros(n, np.uint64)
            for part in pick:
                total = mix(total * np.uint64(3) + part)
            out[:, t, i] = np.uint64(t << 32) | total >> np.uint64(32)
    return out.reshape(n, -1).view(np.int64)


def _hash(planes_of, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lengths = np.array([len(v) for v in part.column(2)])
                for dim in np.unique(lengths).tolist():
                    own = part.take(pa.array(np.flatnonzero(lengths == dim)))
                    raw = np.array(own.column(2).to_pylist(), np.float64).reshape(-1, dim)
                    peak = np.abs(raw).max(1, keepdims=True)
                    unit = raw / peak
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    blobs = pa.array([x.tobytes() for x in (raw.astype(np.float32) if width == 4 else raw)], pa.binary())
                    found = cells(unit, planes_of(dim))
                    marks = pa.array([x.tobytes() for x in found.astype(np.uint32)], pa.binary())  # the table follows from the place
                    yield pa.record_batch([own.column(0), own.column(1), blobs, marks, pa.array(list(found), pa.list_(pa.int64()))], ["rep", "copies", "vector", "marks", "cells"])

    return run


def _labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric adjacency matrix, the smallest row reachable."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _bytes(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a binary column start and end, and the bytes."""
    column = rows.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = column.buffers()
    return np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1], np.frombuffer(data, np.uint8)


class _Rows:
    """Columns of a table of rows as arrays; vectors of each length are one matrix of unit vectors."""

    def __init__(self, rows: pa.Table, kind: type, per_table: int) -> None:
        self.n = rows.num_rows
        self.cell, self.i, self.j, self.block, self.rep, self.copies = (rows.column(k).to_numpy() for k in ("cell", "i", "j", "block", "rep", "copies"))
        ends, data = _bytes(rows, "vector")
        self.length = np.diff(ends)
        self.place, self.units = np.empty(self.n, np.int64), {}
        for size in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == size)
            raw = data[ends[own][:, None] + np.arange(size)].view(kind).astype(np.float64) if len(own) < self.n else data[ends[0] : ends[-1]].view(kind).reshape(self.n, -1).astype(np.float64)
            unit = raw / np.abs(raw).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            self.place[own], self.units[size] = np.arange(len(own)), unit
        ends, data = _bytes(rows, "marks")
        self.marks = data[ends[0] : ends[-1]].view(np.uint32).reshape(self.n, -1, per_table)

    def near(self, own: slice, threshold: float) -> np.ndarray:
        """Which rows of the slice reach the threshold with each other."""
        length, place = self.length[own], self.place[own]
        if (length == length[0]).all():
            unit = self.units[int(length[0])][place]
            return unit @ unit.T >= threshold
        out = np.zeros((len(length), len(length)), bool)
        for size in np.unique(length).tolist():
            some = np.flatnonzero(length == size)
            unit = self.units[size][place[some]]
            out[np.ix_(some, some)] = unit @ unit.T >= threshold
        return out


def _compare(threshold: float, width: int, per_table: int):
    """Rows of one group (cell, i, j) come together; i and j number its blocks."""
    kind = np.float32 if width == 4 else np.float64

    def group(rows: _Rows, own: slice) -> tuple[np.ndarray, ...] | None:
        linked = rows.near(own, threshold)
        np.fill_diagonal(linked, False)
        if not linked.any():
            return None
        order = np.argsort(rows.rep[own], kind="stable")
        linked = linked[np.ix_(order, order)]
        rep, copies, block = rows.rep[own][order], rows.copies[own][order], rows.block[own][order]
        root = rep[_labels(linked)]
        if rows.i[own.start] != rows.j[own.start]:
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(linked))
        n = np.zeros(len(rep), np.int64)
        marks = rows.marks[own][order]
        table, mark = divmod(int(rows.cell[own.start]), 1 << 32)
        for at in range(0, len(a), 20_000):
            x, y = a[at : at + 20_000], b[at : at + 20_000]
            for t in range(table):  # pairs that an earlier table has too count there
                apart = ~(marks[x, t][:, :, None] == marks[y, t][:, None, :]).any((1, 2))
                x, y = x[apart], y[apart]
            mx = marks[x, table]
            first = ~((mx[:, :, None] == marks[y, table][:, None, :]) & (mx < mark)[:, :, None]).any((1, 2))
            np.add.at(n, x[first], copies[y[first]])
            np.add.at(n, y[first], copies[x[first]])
        some = (n > 0) | (root != rep)
        return rep[some], n[some], root[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_groups(batches, ("cell", "i", "j")):
            rows = _Rows(table, kind, per_table)
            out = [x for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s > 1 and (x := group(rows, slice(s, e)))]
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rep", "n", "root"])

    return run


def linked(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tables: int | None = None, halves: int | None = None, scale: float = SCALE, seed: int = 7) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of different
    lengths don't link. Rows that repeat a key are vectors of their own. A row with a null key counts for others as a
    vector, names no component unless all do, and is kept. No rows give no rows. Other columns are left out, so their names
    can't clash. ``halves`` and ``tables`` follow from the number of different vectors unless they are given.
    """
    width = 4 if vectors.schema[vector].dataType.elementType.simpleString() == "float" else 8
    v = F.col("vector")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("vector"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("x", F.xxhash64("vector")).withColumn("y", F.xxhash64(F.lit("salt"), "vector"))
    exact = rows.where("good").groupBy("x", "y").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    exact = written(exact.withColumn("rep", F.coalesce("rep", F.lit(1 << 62) + F.pmod("x", F.lit(1 << 60)))), "vectors")

    n = exact.count()
    if halves is None or tables is None:
        halves, tables = next((halves or h, tables or t) for most, h, t in SETTINGS if n <= most)

    def planes_of(dim: int, known: dict = {}) -> np.ndarray:  # noqa: B006  one set of planes for each length and process
        if dim not in known:
            known[dim] = projections(dim, tables, halves, scale, seed)
        return known[dim]

    hashed = written(mapped(exact.select("rep", "copies", "vector"), _hash(planes_of, width), "rep long, copies long, vector binary, marks binary, cells array<long>"), "cells")
    # a cell may come twice among one vector's cells
    spread = hashed.select("rep", F.explode(F.array_distinct("cells")).alias("cell"))
    sizes = written(spread.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "sizes", n * tables * 2**halves)
    places = written(spread.join(sizes, "cell"), "spread")
    full = in_block_pairs(places, "cell", "rep", "n", BLOCK).join(hashed.drop("cells"), "rep").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    met = written(mapped(full.select("cell", "i", "j", "block", "rep", "copies", "vector", "marks"), _compare(threshold, width, 2**halves), "rep long, n long, root long"), "links")
    dropped(sizes, places, hashed)
    counts = met.groupBy("rep").agg(F.sum("n").alias("n"))
    whole = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    found = exact.join(counts, "rep", "left").join(whole.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = found.select("x", "y", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    named = rows.select("id", "good", "x", "y").join(written(found, "found", n), ["x", "y"], "left")
    component = F.when(F.col("good") & (F.col("component") < (1 << 61)), F.col("component")).otherwise(F.col("id"))
    named = named.select("id", F.when(F.col("good"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return named.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
