"""Scans: the grid of cells that a scan plans, what was recorded of each, and what that covers.

A cell is one list that is read page by page: for a search a window of days and a channel (a keyword, or kinds), for an
archive a channel alone, whose pages go from the newest entry back. Recorded pages are rows (source, channel, window_start,
page from 1, status, total_pages, total_records, shown, oldest, newest); pages of the same number count once, the last
``seq`` first where that column is there. All windows here are over the pages of one cell, or the cells of one channel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEARCH, ARCHIVE = "search", "archive"
CELL = ("source", "channel", "window_start")


def grid(plan: DataFrame, first: str, last: str) -> DataFrame:
    """The cells of a scan from the plan (source, kind, channels, window_days, most_pages): no row is made for a source without channels."""
    days = F.array(F.struct(F.lit(first).cast("date").alias("window_start"), F.lit(last).cast("date").alias("window_end")))
    width = F.greatest(F.col("window_days"), F.lit(1))
    starts = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.make_dt_interval(width))
    windows = F.transform(starts, lambda d: F.struct(d.alias("window_start"), F.least(F.date_add(d, width - 1), F.lit(last).cast("date")).alias("window_end")))
    cells = plan.withColumn("channel", F.explode(F.array_distinct("channels"))).withColumn("w", F.explode(F.when(F.col("kind") == ARCHIVE, days).otherwise(windows)))
    return cells.select("source", "kind", "channel", "w.window_start", "w.window_end", "most_pages")


def unread(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Cells of which nothing was recorded."""
    return cells.join(pages.select(*CELL).distinct(), list(CELL), "left_anti")


def states(cells: DataFrame, pages: DataFrame, first: str, last: str) -> DataFrame:
    """cells with state, pages and notices read, oldest, newest, missing (ranges of page numbers), reached_start, reached_end and truncated.

    Pages count from 1 on as long as each is there and can be read. Then the state is
    complete: a search's last page, by its own total, or an archive's page that is older than the range or empty;
    boundary: an archive's next page isn't kept any more (404); limit: as many pages as the plan allows;
    failed: the next page has an error, or contradicts its own totals; gap: it wasn't recorded; unread: nothing was.
    Cells that aren't planned have no row.
    """
    c = F.col
    one = pages.groupBy(*CELL, "page").agg(F.max_by(F.struct("status", "total_pages", "total_records", "shown", "oldest", "newest"), F.col("seq") if "seq" in pages.columns else F.lit(0)).alias("p"))
    rows = cells.join(one.select(*CELL, "page", "p.*"), list(CELL), "left")
    cell = Window.partitionBy(*CELL).orderBy("page")
    some = c("shown") > 0
    agrees = F.when(c("total_records") == 0, ~some).otherwise(some & c("total_pages").between(c("page"), F.greatest(c("page"), c("total_pages"))))
    good = F.coalesce((c("status") == 200) & F.when(c("kind") == ARCHIVE, c("shown").isNotNull()).otherwise(agrees), F.lit(False))
    rows = rows.withColumn("good", good).withColumn("before", F.lag("page", 1, 0).over(cell))
    broken = F.max(F.when(c("good") & (c("page") == c("before") + 1), 0).otherwise(1)).over(cell.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("read", broken == 0)
    end = F.when(c("kind") == ARCHIVE, (c("shown") == 0) | (c("newest") < F.lit(first).cast("date"))).otherwise((c("total_records") == 0) | (c("page") >= c("total_pages")))
    gone = F.when(c("page") > c("before") + 1, F.struct((c("before") + 1).alias("first"), (c("page") - 1).alias("last")))
    read = c("read")
    found = rows.groupBy(*CELL, "kind", "window_end", "most_pages").agg(
        F.count("page").alias("recorded"),
        F.count_if("read").alias("pages"),
        F.coalesce(F.sum(F.when(read, c("shown"))), F.lit(0)).alias("notices"),
        F.min(F.when(read, c("oldest"))).alias("oldest"),
        F.max(F.when(read, c("newest"))).alias("newest"),
        F.coalesce(F.bool_or(read & end), F.lit(False)).alias("ended"),
        F.coalesce(F.bool_or(read & (c("shown") == 0)), F.lit(False)).alias("empty"),
        F.array_sort(F.collect_list(gone)).alias("gaps"),
        F.max("page").alias("top"),
        F.max(F.when(c("kind") != ARCHIVE, c("total_pages"))).alias("total"),
        F.min_by("status", F.when(~read, c("page"))).alias("next_status"),
        F.min(F.when(~read, c("page"))).alias("next_page"),
    )
    follows = c("next_page") == c("pages") + 1
    state = (
        F.when(c("recorded") == 0, "unread")
        .when(c("ended"), "complete")
        .when(c("pages") >= c("most_pages"), "limit")
        .when(follows & (c("kind") == ARCHIVE) & (c("next_status") == 404) & (c("pages") > 0), "boundary")
        .when(follows, "failed")
        .otherwise("gap")
    )
    ranges, top, total = "array<struct<first:int,last:int>>", F.coalesce("top", F.lit(0)), F.least("total", "most_pages")
    rest = F.when(F.col("total").isNotNull() & (total > top), F.array(F.struct((top + 1).alias("first"), total.alias("last"))).cast(ranges)).otherwise(F.array().cast(ranges))
    found = found.withColumn("state", state).withColumn("missing", F.concat(c("gaps").cast(ranges), rest))
    whole = c("state") == "complete"
    start = F.when(c("kind") == ARCHIVE, c("empty") | F.coalesce(c("oldest") < F.lit(first).cast("date"), F.lit(False))).otherwise(whole)
    until = F.when(c("kind") == ARCHIVE, c("empty") | F.coalesce(c("oldest") <= F.lit(last).cast("date"), F.lit(False))).otherwise(whole)
    found = found.withColumn("reached_start", start).withColumn("reached_end", until)
    cut = F.when(c("kind") == ARCHIVE, (c("state") == "boundary") | ~c("reached_start")).otherwise(~whole)
    return found.withColumn("truncated", cut).select(*CELL, "window_end", "kind", "state", "pages", "notices", "oldest", "newest", "missing", "reached_start", "reached_end", "truncated")


def covered(cells: DataFrame) -> DataFrame:
    """(source, channel, first, last, windows): runs of complete windows that follow each other without a day between, from states()."""
    by = Window.partitionBy("source", "channel").orderBy("window_start")
    whole = cells.where("state = 'complete'")
    starts = F.coalesce(F.datediff("window_start", F.lag("window_end").over(by)) > 1, F.lit(True))
    runs = whole.withColumn("starts", starts).withColumn("run", F.count_if("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("source", "channel", "run").agg(F.min("window_start").alias("first"), F.max("window_end").alias("last"), F.count("*").alias("windows")).drop("run")


def summary(cells: DataFrame, first: str, last: str) -> DataFrame:
    """One row for each source, from states(): what operators.coverage.rollup and status take, and a message for what is missing."""
    found = cells.groupBy("source").agg(
        F.min(F.greatest("oldest", F.lit(first).cast("date"))).alias("first_date"),
        F.max(F.least("newest", F.lit(last).cast("date"))).alias("last_date"),
        F.sum("pages").alias("pages"),
        F.sum("notices").alias("notices"),
        F.bool_and("reached_start").alias("reached_start"),
        F.bool_and("reached_end").alias("reached_end"),
        F.bool_or("truncated").alias("truncated"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "unread").alias("unread"),
        F.count_if(F.col("state") == "boundary").alias("boundaries"),
        F.count_if(F.col("state").isin("limit", "gap")).alias("cut"),
    )
    said = lambda n, what: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(what)))
    message = F.concat_ws("; ", said("unread", " lists not read"), said("failed", " lists with an error"), said("boundaries", " archives that go back no further"), said("cut", " lists cut short"))
    return found.withColumn("message", message).drop("unread", "boundaries", "cut")
