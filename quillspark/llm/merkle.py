"""A Merkle tree over a table of rows, its proofs, and checking them.

Rows are leaves, in groups by one column. Leaves are sorted into runs by Spark's range partitioning, numbered within their
group from the runs' counts, and written as level 0 of the node store; each level is a partition of the store's Parquet
table and is made by one pass over the level before it, by coordinate (group, number // fan), until each group has one
node. The groups' nodes are leaves of a second tree above, whose last node is the root. A node keeps its children's
digests, so the way from the root down is one merge of two tables by coordinate for each level, and rows there are an
eighth of those below. Nothing but the largest group's size and the root comes to the driver.

A digest is the lowercase hex SHA-256 of its inputs' concatenated text.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, own_folder, written

#: Children of a node.
FAN = 8
#: Steps of a proof, from the leaf up: the digests to the left and to the right of the one that is known.
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf holds it: '-' for null, else its UTF-8 byte count, ':' and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    return digest(*map(field, fields))


def numbered(rows: DataFrame, by: str, order: list[str], label: str) -> DataFrame:
    """rows, a written table, with ``number`` from 0 in the given order within each ``by``, and ``count``, the rows of ``by``.

    Rows equal in all of these may stand either way. They are sorted into runs by range, the last column being a mark of the
    row, so that very many equal ones don't meet in one task; a run's rows of one ``by`` follow each other, and a table of
    a row for each run and ``by`` says where they start. Nulls of ``order`` come first.
    """
    marked = rows.withColumn("mark", F.monotonically_increasing_id())
    keys = [by, *order, "mark"]
    runs = written(marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("mark").withColumn("at", F.monotonically_increasing_id()), label)
    starts = runs.groupBy(F.shiftright("at", 33).alias("run"), F.col(by).alias("run_of")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy("run_of")
    before = F.coalesce(F.sum("n").over(of.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("run", "run_of", (before - F.col("first")).alias("shift"), F.sum("n").over(of).alias("count"))
    same = (F.shiftright(runs["at"], 33) == starts["run"]) & (runs[by] == starts["run_of"])
    found = runs.join(starts, same).withColumn("number", F.col("at") + F.col("shift")).drop("at", "run", "run_of", "shift")
    found.made_from = runs
    return found


class Tree(NamedTuple):
    """The node store of one tree: levels[k] is (of, number, count, digest, children), level 0 without children."""

    levels: list[DataFrame]
    fan: int

    def tops(self) -> DataFrame:
        """(of, digest): each group's last node."""
        found = [level.where("count = 1").select("of", "digest") for level in self.levels]
        return _union(found)

    def paths(self, tops: DataFrame) -> DataFrame:
        """(of, parent, children, path): for each node above leaves its children, and the steps from it up; ``tops`` has (of, path), the steps from each group's last node on.

        From the top level down, a level's nodes meet what is known of their parents by coordinate; a group's last node takes
        its steps from ``tops``.
        """
        known, found = None, []
        for k in range(len(self.levels) - 1, 0, -1):
            nodes = self.levels[k]
            ends = nodes.where("count = 1").join(tops.withColumnRenamed("of", "top_of"), F.col("of") == F.col("top_of")).select("of", "number", "children", "path")
            if known is not None:
                ends = ends.union(nodes.where("count > 1").select("of", "number", "children").join(known, ["of", "number"]))
            if k == 1:
                return ends.withColumnRenamed("number", "parent")
            below = ends.select("of", "number", "path", F.posexplode("children").alias("place", "child"), "children")
            found.append(known := written(below.select("of", (F.col("number") * self.fan + F.col("place")).alias("number"), _up(F.col("children"), F.col("place"), F.col("path")).alias("path")), "merkle-paths"))
        return None

    def drop(self) -> None:
        dropped(*self.levels)


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *others = frames
    for df in others:
        first = first.union(df)
    return first


def _up(children: Column, place: Column, path: Column) -> Column:
    """The steps from a child: one within its parent, then the parent's."""
    step = F.struct(F.array_join(F.slice(children, F.lit(1), place), "").alias("before"), F.array_join(F.slice(children, place + 2, F.size(children)), "").alias("after"))
    return F.concat(F.array(step), path)


def grown(leaves: DataFrame, largest: int, fan: int = FAN) -> Tree:
    """The tree over (of, number, count, digest), where no group has over ``largest`` rows: a job for each level, that is the logarithm of ``largest``."""
    path = f"{own_folder(leaves.sparkSession)}/merkle-{uuid.uuid4().hex}"
    levels, level = [], leaves.select("of", "number", "count", "digest")
    while True:
        place = f"{path}/level={len(levels)}"
        level.write.option("compression", "zstd").parquet(place)
        kept = leaves.sparkSession.read.schema(level.schema).parquet(place)
        kept.written_to = place
        levels.append(kept)
        if largest <= 1:
            return Tree(levels, fan)
        largest = -(-largest // fan)
        groups = kept.where("count > 1").groupBy("of", F.floor(F.col("number") / fan).cast("long").alias("number"))
        found = groups.agg(F.ceil(F.first("count") / fan).cast("long").alias("count"), F.array_sort(F.collect_list(F.struct("number", "digest")))["digest"].alias("children"))
        level = found.select("of", "number", "count", digest(F.array_join("children", "")).alias("digest"), "children").sortWithinPartitions("of", "number")


class Manifest(NamedTuple):
    """A table's trees: ``rows`` has (row, of, number, count, leaf, changed), ``lower`` a tree for each group, ``upper`` the one over them."""

    rows: DataFrame
    lower: Tree
    upper: Tree
    tops: DataFrame
    root: str | None

    def drop(self) -> None:
        dropped(self.rows, self.tops)
        self.lower.drop()
        self.upper.drop()


def group_key(group: Column) -> Column:
    """A group's name as a text that sorts as it does, null first: '' for null, else '=' and the name."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def manifest(rows: DataFrame, group: str, order: str, fields: list[str], changed: dict[str, Column] | None = None, fan: int = FAN) -> Manifest:
    """The trees over rows: a leaf for each, of ``fields``; groups by ``group``, their leaves by ``order``, nulls first, then by leaf.

    ``changed`` gives columns that are other now than when the manifest was made; the leaf that they would give stands
    beside the true one. Rows that are equal in group, order and fields are leaves of their own with one digest, so which
    of them comes first changes no result. A null group is a group. No rows give no trees, and no root. Columns that aren't
    named here are left out, so their names can't clash.
    """
    now = changed or {}
    leaf = leaf_of([rows[c] for c in fields])
    other = leaf_of([now.get(c, rows[c]) for c in fields])
    differs = F.lit(False)
    for c, value in now.items():
        differs = differs | ~value.eqNullSafe(rows[c])
    leaves = rows.select(group_key(rows[group]).alias("of"), rows[order].alias("row"), leaf.alias("leaf"), F.when(differs, other).alias("changed"))
    leaves = written(leaves, "merkle-leaves")
    found = numbered(leaves, "of", ["row", "leaf"], "merkle-runs")
    kept = written(found.select("of", "number", "count", "row", "leaf", "changed"), "merkle-rows")
    dropped(leaves, found.made_from)
    largest = kept.agg(F.max("count")).first()[0] or 0
    lower = grown(kept.select("of", "number", "count", F.col("leaf").alias("digest")), largest, fan)
    tops = written(lower.tops().select(F.lit("").alias("all"), "of", F.col("digest").alias("subroot")), "merkle-subroots")
    ranked = numbered(tops, "all", ["of"], "merkle-groups")
    over = written(ranked.select(F.col("all").alias("of"), "number", "count", F.col("subroot").alias("digest"), F.col("of").alias("group")), "merkle-tops")
    dropped(tops, ranked.made_from)
    upper = grown(over, over.agg(F.max("count")).first()[0] or 0, fan)
    root = upper.tops().first()
    return Manifest(kept, lower, upper, over, root and root["digest"])


def steps(leaves: DataFrame, tree: Tree, tops: DataFrame) -> DataFrame:
    """leaves, with (of, number, count), and ``path``: their steps up to what ``tops`` has for their group, and on."""
    alone = leaves.where("count = 1").join(tops.withColumnRenamed("of", "top_of"), F.col("of") == F.col("top_of")).drop("top_of")
    if (parents := tree.paths(tops)) is None:
        return alone
    parents = parents.withColumnRenamed("of", "parent_of")
    same = (F.col("of") == F.col("parent_of")) & (F.floor(F.col("number") / tree.fan).cast("long") == F.col("parent"))
    under = leaves.where("count > 1").join(parents, same)
    under = under.withColumn("path", _up(F.col("children"), F.pmod("number", F.lit(tree.fan)).cast("int"), F.col("path"))).drop("parent_of", "parent", "children")
    return under.union(alone)


def proofs(made: Manifest) -> DataFrame:
    """(row, leaf, changed, subroot, root, path): a proof for each row, the steps from its leaf to the root."""
    none = made.tops.select("of").distinct().withColumn("path", F.array().cast(STEPS))
    groups = written(steps(made.tops, made.upper, none).select(F.col("group").alias("of"), F.col("digest").alias("subroot"), "path"), "merkle-groups")
    found = steps(made.rows, made.lower, groups.select("of", "path"))
    subroots = groups.select(F.col("of").alias("sub_of"), "subroot")
    found = found.join(subroots, F.col("of") == F.col("sub_of"))
    return found.select("row", "leaf", "changed", "subroot", F.lit(made.root).cast("string").alias("root"), "path")


def siblings(path: Column) -> Column:
    """The text of all digests of a proof, level by level from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(path, leaf, lambda known, s: digest(s["before"], known, s["after"]))


def checked(made: Manifest) -> DataFrame:
    """(row, leaf, subroot, root, proof_sha256, folded_root, verified): what the proof of each row gives with the leaf that the row has now."""
    found = proofs(made)
    root = folded(F.coalesce("changed", "leaf"), F.col("path"))
    found = found.select("row", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: A to Z as they are lower-cased; other letters stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_text(key: Column, text: Column) -> Column:
    """The text after tampering: A to Z lower-cased where 3 divides the CRC-32 of the decimal key; a null key or text changes nothing."""
    return F.when(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)
