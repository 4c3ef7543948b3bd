"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame operations only.

A document's key is -ln(u) / w, with u from the MD5 of its id and w its quality weight; taken in rising order, keys give a
weighted sample without replacement of any size. A source whose target is t words and whose documents have s words is
taken floor(t / s) times as a whole; what is left of t is filled with documents in the order of their keys, by a prefix
sum of their sizes. The document across the border is taken if that ends nearer to the target.

No source is sorted in one task: its keys are cut into ranges of about ``SLICE`` documents, sizes are summed within a
range, and each range starts from the sum of those before it. Rows meet what is known of their source on (source, salt),
so a source with a third of all rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Documents of one range of keys.
SLICE = 4000
SALTS = 32
#: A source is taken at most so many times.
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.0, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n): sources by code point, null last, weigh 1, 2, 3, 1, ...

    Targets share ``share`` of all sizes by weight; one that would exceed ``most`` times its source's size stops there,
    and the others share the rest by weight. That is target = min(most * size, weight * level) at the one level at which
    the targets' sum is right. Ordered by size / weight, the sources that stop are a prefix; the level follows from prefix sums.
    These windows take one row for each source.
    """
    everything, before = Window.partitionBy(), Window.orderBy("reach", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double")).withColumn("reach", most * F.col("source_size") / F.col("weight"))
    ranked = ranked.withColumn("full", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
    ranked = ranked.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("full")) / F.col("open"))
    # the first source that the level of those from it on doesn't fill sets the level for all
    level = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "rank", "level"))).over(everything)["level"]
    target = F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def plan(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, most: int = MOST) -> DataFrame:
    """(key, content, source, size, source_size, target, copies, taken) for each row: how often the mix takes it, and the words that gives.

    labels: (key, quality); a good document (1) weighs 2, a bad one (0) 0.5, others 1; of several labels of one document
    the best counts. content is a hash of the text. A null or empty text has size 0 and takes no words; null sources are
    one source; rows that repeat a key are rows of their own (which of equals comes first changes no result); no rows give no rows.
    Other columns are left out, so their names can't clash.
    """
    base = docs.select(docs[key].alias("key"), docs[source].alias("source"), n_words(docs[text]).alias("size"), F.xxhash64(docs[text]).alias("content"))
    weight = F.lit(1.0)
    if labels is not None:
        best = labels.groupBy(F.col(key).alias("labelled")).agg(F.max("quality").alias("quality"))
        base = base.join(best, base["key"] == best["labelled"], "left").drop("labelled")
        weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    base = base.withColumn("order", -F.log(u) / weight)
    # 1 - exp(-key) lies in (0, 1) and rises with the key: it deals the keys of a source into ranges
    base = base.withColumn("place", -F.expm1(-F.col("order"))).withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "key", "content"), F.lit(SALTS)))
    base = written(base.select("key", "content", "source", "size", "order", "place", "salt"), "mix")
    sources = targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), share, most)
    salted = sources.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")).withColumnRenamed("source", "of")
    rows = base.join(salted, base["source"].eqNullSafe(salted["of"]) & (base["salt"] == salted["salt"]), "left").drop("of", "salt")
    rows = written(rows.withColumn("slice", F.floor(F.col("place") * F.ceil(F.col("n") / F.lit(float(SLICE))))), "mixed")
    parts = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("of"), F.col("slice").alias("at"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    rows = rows.join(parts, rows["source"].eqNullSafe(parts["of"]) & (rows["slice"] == parts["at"]), "left")
    within = Window.partitionBy("source", "slice").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    upto = F.col("before") + F.sum("size").over(within)
    copies = F.least(epochs + F.when(upto - F.col("size") / 2.0 < rest, 1).otherwise(0), F.lit(most)).cast("int")
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return rows.select(F.col("key").alias(key), "content", F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST) -> DataFrame:
    """The mix itself: the rows of docs with their columns, each as often as the mix takes it (not at all, or up to ``most`` times).

    The plan holds no texts; it meets the rows on key, text hash and, for rows that repeat both, their number. Nulls, empty
    texts and repeated rows are as in plan(); other columns are carried along whatever their names.
    """
    nth = F.row_number().over(Window.partitionBy("id", "content").orderBy("id"))
    planned = plan(docs, labels, key, text, source, most=most).select(F.col(key).alias("id"), "content", "copies").withColumn("nth", nth)
    planned = planned.where("copies > 0").toDF("plan_id", "plan_content", "copies", "plan_nth")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[key].alias("id"), F.xxhash64(docs[text]).alias("content")).withColumn("nth", nth)
    # the number isn't a join key, so both windows' partitioning serves the join too
    same = rows["id"].eqNullSafe(planned["plan_id"]) & (rows["content"] == planned["plan_content"]) & (rows["nth"] - planned["plan_nth"] == 0)
    return rows.join(planned, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
