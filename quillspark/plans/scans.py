"""Queries over scans: the events stand for entries of lists that were read page by page, with pages left out and pages that failed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage
from ..sources import scan
from .registry import query, table

FIRST, LAST = "2024-01-08", "2024-02-11"
#: The sources, how they are scanned, and the number of pages that the plan allows.
PLAN = (("click", "search", 7, 9), ("view", "search", 14, 9), ("purchase", "search", 7, 5), ("signup", "search", 10, 9), ("error", "archive", 1, 9))


def recorded(spark, d):
    """Pages as they were recorded: of each cell 7 (an archive: one for each five days), some missing, some with errors."""
    e = table(spark, d, "events").where("event_id >= 0 and ts is not null")
    plan = spark.createDataFrame(PLAN, "source string, kind string, window_days int, most_pages int")
    rows = e.select("event_id", F.to_date("ts").alias("day"), F.col("event_type").alias("source"), (F.col("event_id") % 3).alias("c")).join(plan, "source")
    archive, start = F.col("kind") == "archive", F.lit(FIRST).cast("date")
    number = F.when(archive, F.lit(0)).otherwise(F.floor(F.datediff("day", start) / F.col("window_days"))).cast("int")
    page = F.when(archive, 1 + F.floor(F.datediff(F.lit("2024-01-30").cast("date"), "day") / 5)).otherwise(1 + F.floor(F.col("event_id") / 3) % 7).cast("int")
    rows = rows.where(archive | (F.col("day") >= start)).withColumns({"number": number, "page": page}).withColumn("window_start", F.when(archive, start).otherwise(F.date_add(start, F.col("number") * F.col("window_days"))))
    cells = rows.groupBy("source", "kind", "c", "number", "window_start", "page").agg(F.count("*").alias("shown"), F.min("day").alias("oldest"), F.max("day").alias("newest"))
    mark = 3 * F.col("number") + F.col("c") + 5 * F.col("page") + F.length("source")
    status = F.when(archive & (F.col("c") == 1) & (F.col("page") > 3), 404).when(mark % 29 == 0, 503).otherwise(200)
    cells = cells.where(mark % 17 != 0).withColumn("status", status)
    return cells.select("source", F.concat(F.lit("c"), "c").alias("channel"), "window_start", "page", "status", F.lit(7).alias("total_pages"), F.lit(140).alias("total_records"), "shown", "oldest", "newest")


def scanned(spark, d):
    plan = spark.createDataFrame(PLAN, "source string, kind string, window_days int, most_pages int").withColumn("channels", F.array(*(F.lit(f"c{n}") for n in range(3))))
    return scan.states(scan.grid(plan, FIRST, LAST), recorded(spark, d), FIRST, LAST)


_PLAN = "(values " + ", ".join(f"('{s}', '{k}', {w}, {m})" for s, k, w, m in PLAN) + ") p(source, kind, window_days, most_pages)"
_STATES = f"""with p as (select * from {_PLAN}), e as (
  select p.*, event_id % 3 as c, ts::date as day, case when kind = 'archive' then 0 else (ts::date - date '{FIRST}') // window_days end as number,
         case when kind = 'archive' then 1 + (date '2024-01-30' - ts::date) // 5 else 1 + event_id // 3 % 7 end as page
  from events join p on event_type = source where event_id >= 0 and (kind = 'archive' or ts::date >= date '{FIRST}')
), r as (
  select source, kind, c, number, page, count(*) as shown, min(day) as oldest, max(day) as newest,
         case when kind = 'archive' and c = 1 and page > 3 then 404 when (3 * number + c + 5 * page + length(source)) % 29 = 0 then 503 else 200 end as status
  from e group by all having (3 * number + c + 5 * page + length(source)) % 17 <> 0
), g as (
  select source, kind, c, most_pages, number, date '{FIRST}' + (number * window_days)::int as window_start, case when kind = 'archive' then date '{LAST}' else least(date '{FIRST}' + (number * window_days + window_days - 1)::int, date '{LAST}') end as window_end
  from p, (select unnest(range(0, 3)) as c), (select unnest(range(0, 40)) as number)
  where case when kind = 'archive' then number = 0 else date '{FIRST}' + (number * window_days)::int <= date '{LAST}' end
), l as (
  select g.*, list(r.page) filter (r.page is not null) as all_pages, list(r.page) filter (r.status = 200) as good,
         coalesce(list_min(list_filter(range(1, 50), lambda n: not list_contains(coalesce(list(r.page) filter (r.status = 200), []), n))), 1) - 1 as read
  from g left join r on r.source = g.source and r.c = g.c and r.number = g.number group by g.source, g.kind, g.c, g.most_pages, g.number, g.window_start, g.window_end
), m as (
  select l.source, l.kind, l.c, l.most_pages, l.window_start, l.window_end, l.read, coalesce(l.all_pages, []) as all_pages, coalesce(sum(r.shown), 0)::bigint as notices, min(r.oldest) as oldest, max(r.newest) as newest,
         coalesce(bool_or(case when l.kind = 'archive' then r.newest < date '{FIRST}' else r.page >= 7 end), false) as ended
  from l left join r on r.source = l.source and r.c = l.c and r.number = l.number and r.page <= l.read group by l.source, l.kind, l.c, l.most_pages, l.window_start, l.window_end, l.read, l.all_pages
), s as (
  select *, case when len(all_pages) = 0 then 'unread' when ended then 'complete' when read >= most_pages then 'limit'
    when list_contains(all_pages, read + 1) then case when kind = 'archive' and c = 1 and read >= 3 then 'boundary' else 'failed' end else 'gap' end as state,
    list_filter(range(1, case when kind = 'archive' then coalesce(list_max(all_pages), 0) else greatest(coalesce(list_max(all_pages), 0), case when len(all_pages) > 0 then least(7, most_pages) else 0 end) end + 1), lambda n: not list_contains(all_pages, n)) as gone
  from m
)"""
_DONE = f"case when kind = 'archive' then coalesce(oldest < date '{FIRST}', false) else state = 'complete' end"


@query(f"""{_STATES} select source, 'c' || c as channel, strftime(window_start, '%Y-%m-%d') as window_start, strftime(window_end, '%Y-%m-%d') as window_end, state, read::bigint as pages, notices, len(gone)::bigint as n_missing, {_DONE} as reached_start,
case when kind = 'archive' then coalesce(oldest <= date '{LAST}', false) else state = 'complete' end as reached_end, case when kind = 'archive' then state = 'boundary' or not {_DONE} else state <> 'complete' end as truncated from s""")
def scan_states(spark, d):
    """Each planned list: how far it was read, why no further, and the pages that are missing."""
    rows = scanned(spark, d)
    missing = F.aggregate("missing", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select("source", "channel", day("window_start"), day("window_end"), "state", "pages", "notices", missing.alias("n_missing"), "reached_start", "reached_end", "truncated")


@query(f"""{_STATES}, w as (select *, window_start - lag(window_end) over (partition by source, c order by window_start) as apart from s where state = 'complete'),
n as (select *, sum(case when apart = 1 then 0 else 1 end) over (partition by source, c order by window_start) as run from w)
select source, 'c' || c as channel, strftime(min(window_start), '%Y-%m-%d') as first, strftime(max(window_end), '%Y-%m-%d') as last, count(*) as windows from n group by source, c, run""")
def scan_ranges(spark, d):
    """The ranges of days that complete windows of a channel cover without a gap."""
    rows = scan.covered(scanned(spark, d))
    return rows.select("source", "channel", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first", "last")), "windows")


@query(f"""{_STATES}, t as (select source, sum(read)::bigint as pages, sum(notices)::bigint as notices, bool_and({_DONE}) as reached_start, bool_and(case when kind = 'archive' then coalesce(oldest <= date '{LAST}', false) else state = 'complete' end) as reached_end,
bool_or(case when kind = 'archive' then state = 'boundary' or not {_DONE} else state <> 'complete' end) as truncated, count(*) filter (state = 'failed') as failed, min(greatest(oldest, date '{FIRST}')) as f, max(least(newest, date '{LAST}')) as l from s group by source)
select source, coalesce(strftime(f, '%Y-%m-%d'), '') as first_date, coalesce(strftime(l, '%Y-%m-%d'), '') as last_date, pages, notices, failed, case when truncated or not reached_start or not reached_end or failed > 0 then 'partial' when notices > 0 then 'ok' else 'empty' end as status from t""")
def scan_summary(spark, d):
    """Each source's coverage and what its status comes to."""
    rows = scan.summary(scanned(spark, d), FIRST, LAST)
    state = coverage.status(F.col("notices"), F.col("reached_start"), F.col("reached_end"), F.col("truncated"), F.lit(0), F.col("failed"))
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)
    return rows.select("source", day("first_date"), day("last_date"), "pages", "notices", "failed", state.alias("status"))
