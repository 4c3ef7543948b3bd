"""Incremental forms of the batch operators. The catalogue grows while a run goes on: each batch is merged as it arrives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from ..operators import upsert
from ..shared import hadoop_path, read_json, write_json


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files under a path, with the batch they arrive in left to the engine."""
    return spark.readStream.schema(schema).parquet(path)


def distinct_within(rows: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First sightings: a key that comes again within the delay isn't passed on, and its state goes after that."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def hourly_counts(rows: DataFrame, time: str, group: str, delay: str) -> DataFrame:
    """(group, hour, n) as event time passes; rows later than the delay don't count."""
    return rows.withWatermark(time, delay).groupBy(group, F.window(time, "1 hour").alias("w")).agg(F.count("*").alias("n")).select(group, F.col("w.start").alias("hour"), "n")


#: So many neighbouring generations of like size become one; and so many batches an outlived generation stays for those who still read it.
FAN, STAY = 8, 8


def merge_into(rows: DataFrame, table: str, checkpoint: str, keys: Sequence[str], sequence: Sequence[str], keep: Sequence[str] = (), available_now: bool = True, fan: int = FAN) -> StreamingQuery:
    """Merges each batch into the table at a path, last writer wins by arrival; columns in ``keep`` stay as they were first written.

    A batch writes its own rows only, as a generation, so what it writes follows the batch and not the table. When ``fan``
    of the newest generations are of like size, they become one, with as many tasks as their size asks for: over time a row is
    written again as often as the logarithm of the table's size. latest() merges what generations there are. Keys and ``keep`` are
    recorded with the table, and others are refused. A batch that runs again writes its own generation again, so a restart changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        layout = {"keys": list(keys), "keep": list(keep)}
        known = read_json(spark, f"{table}/_layout")
        if known is None:
            write_json(spark, f"{table}/_layout", layout)
        elif known != layout:
            raise ValueError(f"{table} has {known}, not {layout}")
        last = upsert.latest_wins(batch, keys, sequence)
        last.write.mode("overwrite").parquet(_place(table, number, number))
        _compact(spark, table, layout, number, fan)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _place(table: str, first: int, last: int) -> str:
    return f"{table}/generation={first:012d}-{last:012d}"


def _generations(spark: SparkSession, table: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, str]]]:
    """(first batch, last batch, bytes, path) of the whole generations that make up the table, oldest first, and (first, last, path) of those that a wider one has outlived."""
    system, root = hadoop_path(spark, table)
    found = []
    for status in system.listStatus(root) if system.exists(root) else []:
        name = status.getPath().getName()
        if name.startswith("generation=") and system.exists(hadoop_path(spark, f"{table}/{name}/_SUCCESS")[1]):
            first, last = map(int, name.partition("=")[2].split("-"))
            found.append((first, last, f"{table}/{name}"))
    counted, outlived = [], []
    for first, last, path in sorted(found, key=lambda g: (g[0], -g[1])):
        if counted and last <= counted[-1][1]:
            outlived.append((first, last, path))
        else:
            counted.append((first, last, int(system.getContentSummary(hadoop_path(spark, path)[1]).getLength()), path))
    return counted, outlived


def _merged(spark: SparkSession, parts: Sequence[tuple[int, int, int, str]], layout: dict) -> DataFrame:
    """Generations as one table: of each key the newest row, with the oldest values of the columns to keep; an aggregate, so no key is hot."""
    if len(parts) == 1:
        return spark.read.parquet(parts[0][3])
    rows = None
    for first, *_, path in parts:
        own = spark.read.parquet(path).withColumn("x_from", F.lit(first))
        rows = own if rows is None else rows.unionByName(own)
    keys, keep = layout["keys"], layout["keep"]
    rest = [c for c in rows.columns if c not in (*keys, *keep, "x_from")]
    found = [F.max_by(F.struct(*rest), "x_from").alias("newest")] if rest else []
    found += [F.min_by(F.struct(*keep), "x_from").alias("oldest")] if keep else []
    merged = rows.groupBy(*keys).agg(*found) if found else rows.select(*keys).distinct()
    pick = lambda c: F.col(c) if c in keys else F.col(f"{'oldest' if c in keep else 'newest'}.{c}").alias(c)
    return merged.select(*(pick(c) for c in rows.columns if c != "x_from"))


def _compact(spark: SparkSession, table: str, layout: dict, number: int, fan: int) -> None:
    """Makes the newest generations one, if there are ``fan`` of which each is at most twice as large as all newer ones; then removes what was outlived long ago."""
    counted, outlived = _generations(spark, table)
    take, size = counted[-1:], sum(g[2] for g in counted[-1:])
    for g in reversed(counted[:-1]):
        if g[2] > 2 * size:
            break
        take.insert(0, g)
        size += g[2]
    if len(take) >= fan:
        _merged(spark, take, layout).write.mode("overwrite").parquet(_place(table, take[0][0], take[-1][1]))
    by = {path: min(g[1] for g in counted if g[0] <= first and last <= g[1]) for first, last, path in outlived}
    for _, _, path in outlived:
        if by[path] + STAY <= number:
            system, place = hadoop_path(spark, path)
            system.delete(place, True)


def latest(spark: SparkSession, table: str) -> DataFrame | None:
    """The table as the generations that are there make it; None if there is none."""
    counted, _ = _generations(spark, table)
    return _merged(spark, counted, read_json(spark, f"{table}/_layout")) if counted else None


def on_each(rows: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
