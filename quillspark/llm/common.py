"""Helpers that the corpus operators share: shared folders, written tables, word hashes, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..shipping import ship

#: A word is a run of characters other than space and the controls U+0009 to U+000D; bytes.split() splits UTF-8 just so.
WORD = r"[^\x20\x09-\x0D]+"

#: A cache of words is emptied when it holds this many; that costs time, never results.
CACHE = 150_000


_FOLDERS: dict[str, str] = {}


def own_folder(spark: SparkSession) -> str:
    """The application's folder under shared_dir(); the file system removes it when the driver ends in good order."""
    name = spark.sparkContext.applicationId
    if name not in _FOLDERS:
        folder = f"{shared_dir(spark)}/{name}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FOLDERS[name] = folder
    return _FOLDERS[name]


#: A table whose number of rows is known is written in parts of about so many.
PART = 100_000


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends here, and lost executors lose none of it.

    ``rows``, a bound of their number where one is known and they are cheap to make, keeps small tables in few files. A
    table stays while the application runs, since results that are read later may need it, unless dropped() removes it.
    """
    path = f"{own_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    dealt = df if rows is None else df.coalesce(max(1, -(-rows // PART)))
    dealt.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing will read any more: all that was made from them is written itself."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with this package sent to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def sampled(rows: DataFrame, order: str, n: int, by: str | None = None) -> DataFrame:
    """Up to about n of the rows that differ in ``order``, a 64-bit hash: those with the smallest. With ``by``, a column of few values, each value has its share of n, and what some can't fill goes to the others.

    Rows with one ``order`` count as one. The driver gets a count for each value of ``by``. A threshold from the numbers of
    distinct rows keeps what a task passes on to its share of the sample.
    """
    columns = rows.columns
    rows = rows.withColumn("sample_of", F.lit("") if by is None else F.col(by).cast("string"))
    counts = {r[0]: max(r[1], 1) for r in rows.groupBy("sample_of").agg(F.approx_count_distinct(order, 0.05)).collect()}
    left, quota = n, {}
    for i, (of, count) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0] or ""))):
        quota[of] = left // (len(counts) - i)
        left -= min(quota[of], count)
    if not quota:
        return rows.select(columns).limit(0)
    near, most = F.lit(False), F.lit(0)
    for of, q in quota.items():
        share = 1.3 * (q + 6 * q**0.5 + 50) / counts[of]
        own = F.col("sample_of").eqNullSafe(F.lit(of))
        near, most = near | (own if share >= 1 else own & (F.col(order) < F.lit(int(-(1 << 63) + share * (1 << 64))))), F.when(own, F.lit(q)).otherwise(most)
    one = rows.where(near).groupBy("sample_of", order).agg(*(F.first(c).alias(c) for c in columns if c != order))
    nth = F.row_number().over(Window.partitionBy("sample_of").orderBy(order))
    return one.withColumn("nth_of", nth).where(F.col("nth_of") <= most).select(columns)


class WordHashes(dict):
    """Word bytes -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(self.shape(word))
        return found

    @staticmethod
    def shape(word: bytes) -> bytes:
        return word


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """So many rows at a time, to bound what Python objects of a batch take."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, starts, ends) of groups whose rows come one after the other; a group that goes on in the next batch waits for it."""
    rest = None
    for batch in chain(batches, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
        if rest is None or not rest.num_rows:
            continue
        rest = rest.combine_chunks()
        differ = np.zeros(rest.num_rows - 1, bool)
        for k in keys:
            column = rest.column(k).to_numpy()
            differ |= column[1:] != column[:-1]
        edge = np.flatnonzero(differ) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, rest.num_rows]
        if batch is not None:
            starts, ends = starts[:-1], ends[:-1]
        if len(ends):
            yield rest, starts, ends
            rest = rest.slice(int(ends[-1]))


def in_block_pairs(rows: DataFrame, group: str, member: str, size: str, block: int) -> DataFrame:
    """rows with block, i and j, each as often as needed for every two rows of a group to meet in one (group, i, j).

    Members are dealt into blocks of about ``block``; two blocks meet in (i, j), and a block with itself in (i, i). The
    rows of a (group, i, j) come together, and those of a hot group are spread over many.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(member), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look independent of the inputs' order (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node reachable.

    Each round maps a node to the smallest of itself and its neighbours and contracts the edges along that map, until
    no edge is left. The smallest node of a component always maps to itself, so it names the component. A node with very
    many neighbours is a hot join key with one row on the other side, which adaptive execution splits.
    Null ends and loops are ignored; no edges give no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps, n = [], edges.count()
    while True:
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        maps.append(up := written(up, "up", 2 * n))
        ends_a = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        ends_b = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(ends_a, "a").join(ends_b, "b").where("ua <> ub")
        moved = moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        last, edges = edges, written(moved, "edges", n)
        dropped(last)
        if not (n := edges.count()):
            break
    roots = maps.pop()
    while maps:
        step = roots.select(F.col("node").alias("up"), F.col("up").alias("root"))
        roots = maps.pop().join(step, "up", "left").select("node", F.coalesce("root", "up").alias("up"))
    return roots.select("node", F.col("up").alias("component"))
