"""Coverage of runs: roll-ups, what each source's state comes to, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(pages: DataFrame, *group: str) -> DataFrame:
    """Parts of a scan (day, pages, notices, reached_start, reached_end, truncated, blocked, failed) as one row for each group."""
    return pages.groupBy(*group).agg(
        F.min("day").alias("first_date"),
        F.max("day").alias("last_date"),
        F.sum("pages").alias("pages"),
        F.sum("notices").alias("notices"),
        F.bool_and("reached_start").alias("reached_start"),
        F.bool_and("reached_end").alias("reached_end"),
        F.bool_or("truncated").alias("truncated"),
        F.sum("blocked").alias("blocked"),
        F.sum("failed").alias("failed"),
    )


def status(notices: Column, reached_start: Column, reached_end: Column, truncated: Column, blocked: Column, failed: Column) -> Column:
    """partial where something is missing, else ok or empty."""
    return F.when(truncated | ~reached_start | ~reached_end | (blocked > 0) | (failed > 0), "partial").when(notices > 0, "ok").otherwise("empty")


def expected(sources: DataFrame, found: DataFrame, key: str, running: bool) -> DataFrame:
    """One row for each expected source: its status, or what it means that it has none."""
    got = found.select(F.col(key).alias("found_key"), F.col("status").alias("found_status"))
    joined = sources.join(got, sources[key] == got["found_key"], "left")
    missing, stuck = ("queued", "running") if running else ("not_started", "interrupted")
    shown = F.when(F.col("found_status").isNull(), missing).when(F.col("found_status") == "running", stuck).otherwise(F.col("found_status"))
    return joined.withColumn("status", shown).drop("found_key", "found_status")


def exit_code(failures: Column, partial: Column) -> Column:
    """0 for a complete run, 2 for one with gaps."""
    return F.when((failures > 0) | (partial > 0), 2).otherwise(0)


def progress(rows: DataFrame, now: Column, idle_seconds: int = 60) -> DataFrame:
    """Sums over a run's sources, how many are done, when something last happened, and whether it stands still."""
    done = F.count_if(~F.col("status").isin("running", "queued", "waiting_verification"))
    last = rows.agg(F.sum(F.greatest("notices", F.lit(0))).alias("notices"), F.count("*").alias("sources"), done.alias("done"), F.max("updated_at").alias("last_update"))
    return last.withColumn("stale", F.coalesce((F.unix_seconds(now) - F.unix_seconds(F.col("last_update").cast("timestamp"))) >= idle_seconds, F.lit(False)) & (F.col("done") < F.col("sources")))
