"""Writes as functions of old state and new rows: last writer wins, conditional merges, versions, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_wins(rows: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """One row for each key: the last to arrive. An aggregate, so it combines before the shuffle and no key is hot."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest)).select(rows.columns)


def _both(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The full join of o and n on equal keys, a null key being equal to another, with in_o and in_n: on which sides a row is."""
    o, n = old.withColumn("in_o", F.lit(True)).alias("o"), new.withColumn("in_n", F.lit(True)).alias("n")
    return o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")


def _key(name: str) -> Column:
    return F.when(F.col("in_n"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new in place of those with their keys; columns in ``keep`` stay as they were. new has one row for each key, and so has old; a null key is a key."""
    there, was = F.col("in_n").isNotNull(), F.col("in_o").isNotNull()
    pick = lambda c: F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in keep else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return _both(old, new, keys).select(*(pick(c).alias(c) for c in old.columns))


def sticky(old: Column, new: Column, weak: Sequence[str], strong: Sequence[str]) -> Column:
    """The new status, but a weak one never displaces a strong one."""
    return F.when(new.isin(*weak) & F.coalesce(old.isin(*strong), F.lit(False)), old).otherwise(new)


def merged_artifacts(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current artifacts after new downloads (keys, sha256, delivery_path, status).

    The same content keeps its delivery path and isn't set back from delivered or review; other content resets both.
    """
    fresh, same = F.col("n.sha256").isNotNull(), F.col("o.sha256") == F.col("n.sha256")
    status = F.when(same, sticky(F.col("o.status"), F.col("n.status"), ("downloaded", "verified"), ("delivered", "review"))).otherwise(F.col("n.status"))
    path = F.when(same, F.coalesce("n.delivery_path", "o.delivery_path")).otherwise(F.col("n.delivery_path"))
    return _both(old, new, keys).select(
        *(_key(k).alias(k) for k in keys),
        F.coalesce("n.sha256", "o.sha256").alias("sha256"),
        F.when(fresh, path).otherwise(F.col("o.delivery_path")).alias("delivery_path"),
        F.when(fresh, status).otherwise(F.col("o.status")).alias("status"),
    )


def merged_refs(old: DataFrame, new: DataFrame, keys: Sequence[str], weak=("available", "discovered"), strong=("downloaded", "failed", "blocked")) -> DataFrame:
    """References after new findings (keys, status): finding one again doesn't undo what was tried."""
    status = F.when(F.col("n.status").isNull(), F.col("o.status")).otherwise(sticky(F.col("o.status"), F.col("n.status"), weak, strong))
    return _both(old, new, keys).select(*(_key(k).alias(k) for k in keys), status.alias("status"))


def versions(rows: DataFrame, keys: Sequence[str], content: str, seen: str) -> DataFrame:
    """(keys, content, first_seen, last_seen, sightings): one row for each content that a key ever had."""
    return rows.groupBy(*keys, content).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count("*").alias("sightings"))


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged."""
    o, n = old.select(F.col(key).alias("k"), F.col(content).alias("c")), new.select(F.col(key).alias("k"), F.col(content).alias("c"))
    change = F.when(F.col("in_o").isNull(), "added").when(F.col("in_n").isNull(), "removed").when(F.col("o.c").eqNullSafe(F.col("n.c")), "unchanged").otherwise("changed")
    return _both(o, n, ["k"]).select(_key("k").alias(key), change.alias("change"))


def first_of_equal(rows: DataFrame, by: Column, *order: str) -> DataFrame:
    """(columns of order, copies): of rows with one ``by`` the first, and how many there are."""
    return rows.groupBy(by.alias("by_key")).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("copies")).select(*(F.col(f"first.{c}").alias(c) for c in order), "copies")


def snapshot(versions_: DataFrame, verdicts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """versions with the verdict's columns on exactly those that it was made for; the others keep what they had."""
    v, c = versions_.alias("v"), verdicts.select(*keys, *columns, F.lit(True).alias("judged")).alias("c")
    joined = v.join(c, [F.col(f"v.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "left")
    return joined.select(*((F.when(F.col("judged"), F.col(f"c.{x}")).otherwise(F.col(f"v.{x}")) if x in columns else F.col(f"v.{x}")).alias(x) for x in versions_.columns))


def within_budget(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """rows with ``granted``: the first ``most`` of each group in order. Groups are sources, so few and even; ties go by all columns."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(group).orderBy(order, *(c for c in rows.columns if c not in (group, order))))
    return rows.withColumn("granted", place <= most)


def projected(rows: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """Each output column is the first of its candidate columns that is there and filled."""
    there = set(rows.columns)
    pick = lambda options: F.coalesce(*(F.nullif(F.col(o).cast("string"), F.lit("")) for o in options if o in there), F.lit(None).cast("string"))
    return rows.select(*(pick(options).alias(name) for name, options in names.items()))
