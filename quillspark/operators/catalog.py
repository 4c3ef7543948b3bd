"""The catalogue: notices with what is known of them, filtered, labelled, paged, counted.

Right-hand sides are aggregated to one row for each notice before they join, so no join multiplies rows. Every operator
takes column names, and works on any table that has them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..joins import spread_join

RELEVANCE = ("all", "relevant", "relevant_pending", "review", "excluded")
DOWNLOADS = ("", "downloaded", "not_downloaded", "partial", "failed")
#: Statuses of notices that review doesn't show.
CLOSED = ("filtered", "excluded", "alias")


@dataclass(frozen=True)
class Page:
    number: int = 1
    size: int = 50

    def __post_init__(self) -> None:
        if isinstance(self.number, bool) or self.number < 1:
            raise ValueError("page must be at least 1")
        if isinstance(self.size, bool) or not 1 <= self.size <= 200:
            raise ValueError("page size must be 1 to 200")


def with_counts(notices: DataFrame, key: str, details: DataFrame, detail_key: str, counts: Mapping[str, Column]) -> DataFrame:
    """notices with counts over their details: pre-aggregated, left joined, 0 where there are none."""
    grouped = details.groupBy(F.col(detail_key).alias("d_key")).agg(*(c.alias(n) for n, c in counts.items()))
    joined = notices.join(grouped, notices[key] == grouped["d_key"], "left").drop("d_key")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in counts})


def free_text(value: str, *columns: Column) -> Column | None:
    """Any of the columns contains the text, of which 200 characters count."""
    value = value.strip()[:200]
    if not value:
        return None
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(text.contains_text(c, value), F.lit(False))
    return out


def day_between(day: Column, first: str = "", last: str = "") -> Column | None:
    """Inclusive, on the first ten characters."""
    short = F.substring(F.coalesce(day, F.lit("")), 1, 10)
    parts = [short >= first.strip()] * bool(first.strip()) + [short <= last.strip()] * bool(last.strip())
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


def relevance(choice: str, relevant: Column, needs_review: Column, status: Column) -> Column | None:
    """relevant, relevant_pending (all that isn't excluded), review (also what was never judged) or excluded; none for all."""
    if choice not in RELEVANCE:
        raise ValueError(f"relevance must be one of {RELEVANCE}")
    return {
        "all": None,
        "relevant": F.coalesce(relevant, F.lit(False)),
        "relevant_pending": F.coalesce(relevant, F.lit(True)) & ~F.coalesce(status.isin("filtered", "excluded"), F.lit(False)),
        "review": (F.coalesce(needs_review, F.lit(False)) | relevant.isNull()) & ~status.isin(*CLOSED),
        "excluded": ~F.coalesce(relevant, F.lit(True)) | status.isin("filtered", "excluded"),
    }[choice]


def download_filter(choice: str, files: Column, attachments: Column, refs: Column, failed: Column) -> Column | None:
    """The filter's idea of a download state; it differs from the label's."""
    if choice not in DOWNLOADS:
        raise ValueError(f"download status must be one of {DOWNLOADS}")
    return {"": None, "downloaded": files > 0, "not_downloaded": files == 0, "partial": (files > 0) & (refs > attachments), "failed": failed > 0}[choice]


def download_label(files: Column, attachments: Column, refs: Column, failed: Column) -> Column:
    return F.when(failed > 0, F.when(files > 0, "partial").otherwise("failed")).when(files > 0, F.when(attachments < refs, "partial").otherwise("downloaded")).otherwise("not_downloaded")


def judged_label(relevant: Column, needs_review: Column, confirmed: Column) -> Column:
    return (
        F.when(F.coalesce(needs_review, F.lit(False)), "review")
        .when(F.coalesce(relevant, F.lit(False)), F.when(F.coalesce(confirmed, F.lit(False)), "confirmed").otherwise("review"))
        .when(~F.coalesce(relevant, F.lit(True)), "excluded")
        .otherwise("pending")
    )


def filtered(rows: DataFrame, *conditions: Column | None) -> DataFrame:
    """rows that meet all conditions; None is no condition."""
    for c in conditions:
        rows = rows if c is None else rows.where(c)
    return rows


def paged(rows: DataFrame, page: Page, *order: Column) -> DataFrame:
    """One page; the order must be total for pages to fit together. Plans as a distributed top-k."""
    return rows.orderBy(*order).offset((page.number - 1) * page.size).limit(page.size)


def totals(rows: DataFrame, size: int) -> DataFrame:
    """(total, pages)."""
    return rows.agg(F.count("*").alias("total")).select("total", F.floor((F.col("total") + size - 1) / size).cast("long").alias("pages"))


def newest_first(day: Column, name: Column, locale: str = "zh") -> list[Column]:
    """The order of a list: newest first, then by name as the locale collates."""
    return [F.coalesce(day, F.lit("")).desc(), F.collate(F.coalesce(name, F.lit("")), locale).asc()]


def counts_by_state(rows: DataFrame, state: str) -> DataFrame:
    """(state, n): how many rows are in each state; null counts as none."""
    return rows.groupBy(F.coalesce(F.col(state), F.lit("")).alias(state)).agg(F.count("*").alias("n"))


def joined_text(column: Column, separator: str = " | ") -> Column:
    """All non-null values of a group in order of value, as one text."""
    return F.array_join(F.sort_array(F.collect_list(column)), separator)


def latest_per_group(rows: DataFrame, group: str, by: str) -> DataFrame:
    """The rows with the greatest ``by`` of their group, all of them where several tie."""
    top = rows.groupBy(F.col(group).alias("top_group")).agg(F.max(by).alias("top_by"))
    same = (rows[group] == top["top_group"]) & (rows[by] == top["top_by"])
    return rows.join(top, same, "left_semi")


def without_match(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    return rows.join(others, rows[key] == others[other_key], "left_anti")


def facet(rows: DataFrame, column: str, defaults: Sequence[str] = ()) -> DataFrame:
    """(value, n): defaults even where nothing has them, every value seen, and the unknown marker for blanks."""
    spark = rows.sparkSession
    seen = rows.groupBy(F.when(text.blank(F.col(column)), text.UNKNOWN).otherwise(F.col(column)).alias("value")).agg(F.count("*").alias("n"))
    fixed = spark.createDataFrame([(x, 0) for x in (*defaults, text.UNKNOWN)], "value string, n long")
    return seen.union(fixed).groupBy("value").agg(F.sum("n").alias("n"))


def aliases(rows: DataFrame, identity: str, by: Column, *priority: Column) -> DataFrame:
    """(alias_identity, canonical_identity): of rows with one key the first by priority stands for the others.

    The first of each key comes from an aggregate, which combines before the shuffle; only keys of several rows join.
    """
    keyed = rows.select(F.col(identity).alias("own"), by.alias("by_key"), F.struct(*priority, F.col(identity).alias("p_id")).alias("rank")).where("by_key is not null")
    first = keyed.groupBy("by_key").agg(F.min("rank")["p_id"].alias("canonical_identity"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = spread_join(keyed.select("own", "by_key"), first, "by_key", "own")
    return joined.where("own <> canonical_identity").select(F.col("own").alias("alias_identity"), "canonical_identity")


def named_both_ways(pairs: DataFrame, rows: DataFrame, identity: str, name: str) -> DataFrame:
    """Alias pairs with the name on either side."""
    left = rows.select(F.col(identity).alias("alias_identity"), F.col(name).alias("alias_name"))
    right = rows.select(F.col(identity).alias("canonical_identity"), F.col(name).alias("canonical_name"))
    return pairs.join(left, "alias_identity").join(right, "canonical_identity").select("alias_identity", "alias_name", "canonical_identity", "canonical_name")


def overlaid(rows: DataFrame, key: str, live: DataFrame, live_key: str, column: str) -> DataFrame:
    """rows whose ``column`` gives way to the live one where there is one."""
    now = live.select(F.col(live_key).alias("live_key"), F.col(column).alias("live_value"))
    joined = rows.join(now, rows[key] == now["live_key"], "left")
    return joined.withColumn(column, F.coalesce("live_value", column)).drop("live_key", "live_value")


def selected(rows: DataFrame, key: str, chosen: DataFrame, chosen_key: str) -> DataFrame:
    return rows.join(chosen, rows[key] == chosen[chosen_key], "left_semi")


def candidates_in_order(rows: DataFrame, group: str, most: int, kind: Column, name: str) -> DataFrame:
    """(group, place, kind, name): the first ``most`` of each group by kind, then name. The ordered set stays bounded while groups are combined by a top-k on sorted rows."""
    place = F.row_number().over(Window.partitionBy(group).orderBy("kind", F.col(name)))
    return rows.withColumn("kind", kind).withColumn("place", place).where(F.col("place") <= most).select(group, "place", "kind", name)


LINK_REASONS = {"no_link": "no direct link was found; see the notice", "unverified": "the source isn't verified; check by hand", "not_downloaded": "the link was found, its response isn't verified"}


ACCESS = {"public_direct": "public link, checked when downloaded", "login_required": "login required", "registration_required": "registration required", "restricted": "access restricted"}


def access_label(access: Column) -> Column:
    """What it takes to open a link; unknown spellings as they are, empty for null."""
    return F.coalesce(F.create_map(*(F.lit(x) for p in ACCESS.items() for x in p))[access], access, F.lit(""))


def link_state(has_attachment: Column, downloaded: Column, ref_status: Column) -> Column:
    table = {"failed": "failed", "blocked": "blocked", "restricted": "manual", "unverified_origin": "unverified"}
    named = F.create_map(*(F.lit(x) for p in table.items() for x in p))[ref_status]
    return F.when(downloaded, "downloaded").otherwise(F.coalesce(named, F.when(has_attachment, "not_downloaded").otherwise("no_link")))


def link_reason(has_attachment: Column, downloaded: Column, verified: Column, known: Column) -> Column:
    return F.when(downloaded, "").when(F.coalesce(known, F.lit("")) != "", known).when(~has_attachment, LINK_REASONS["no_link"]).when(~verified, LINK_REASONS["unverified"]).otherwise(LINK_REASONS["not_downloaded"])


def review_visible(choice: str, verdict: Column) -> Column | None:
    """What the review view shows: keep hides what doesn't match, suspect and exact show one verdict, all everything; a missing verdict is pending."""
    known = F.coalesce(verdict, F.lit("pending"))
    choices = {"all": None, "keep": known != "no_match", "suspect": known == "suspect", "exact": known == "match"}
    if choice not in choices:
        raise ValueError(f"review must be one of {tuple(choices)}")
    return choices[choice]


def spelled(value: Column, groups: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """A free spelling as the first name of which a token is in it, without regard to case."""
    low = F.lower(F.coalesce(value, F.lit("")))
    out = F.lit(default)
    for name, tokens in reversed(groups):
        hit = F.lit(False)
        for t in tokens:
            hit = hit | F.contains(low, F.lit(t.lower()))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out
