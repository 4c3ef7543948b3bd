"""Catalogue queries: pages, filters, labels, facets, exports, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..operators import catalog, coverage
from .registry import query, table



def _counts() -> dict:
    """References, failures, files and files that are attachments."""
    return {
        "refs": F.count("*"),
        "failed": F.count_if(F.col("l_returnflag") == "R"),
        "files": F.count_if(F.col("l_linestatus") == "F"),
        "attachments": F.count_if((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R")),
    }


#: The same notices with counts, for the SQL side.
NOTICES = """
with refs as (
  select l_orderkey, count(*) as refs, count(*) filter (l_returnflag = 'R') as failed, count(*) filter (l_linestatus = 'F') as files,
         count(*) filter (l_linestatus = 'F' and l_returnflag <> 'R') as attachments
  from lineitem group by l_orderkey),
notices as (
  select o.*, c.c_name, c.c_mktsegment, n.n_name, strftime(o.o_orderdate, '%Y-%m-%d') as day, coalesce(r.refs, 0) as refs, coalesce(r.failed, 0) as failed,
         coalesce(r.files, 0) as files, coalesce(r.attachments, 0) as attachments
  from orders o left join customer c on o.o_custkey = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey left join refs r on r.l_orderkey = o.o_orderkey)
"""


def notices(spark: SparkSession, d: str) -> DataFrame:
    buyers = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    joined = table(spark, d, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
    joined = joined.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return catalog.with_counts(joined, "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", _counts())


def _listed(spark: SparkSession, d: str) -> DataFrame:
    rows = notices(spark, d)
    return catalog.filtered(
        rows,
        catalog.free_text("#0000001", F.col("c_name"), F.col("o_orderpriority")),
        catalog.day_between(F.col("day"), "1995-06-01", "2000-06-30"),
        catalog.download_filter("downloaded", F.col("files"), F.col("attachments"), F.col("refs"), F.col("failed")),
    )


_WHERE = "where c_name ilike '%#0000001%' and day between '1995-06-01' and '2000-06-30' and files > 0"


@query(NOTICES + f"select o_orderkey, day, o_orderstatus, o_orderpriority, c_name, n_name, refs, failed, files from notices {_WHERE} order by day desc, o_orderkey limit 50 offset 50")
def catalogue_page(spark, d):
    rows = catalog.paged(_listed(spark, d), catalog.Page(2, 50), F.col("day").desc(), F.col("o_orderkey"))
    return rows.select("o_orderkey", "day", "o_orderstatus", "o_orderpriority", "c_name", "n_name", "refs", "failed", "files")


@query(NOTICES + f"select count(*) as total, (count(*) + 49) // 50 as pages from notices {_WHERE}")
def catalogue_total(spark, d):
    return catalog.totals(_listed(spark, d), 50)


@query("""select c_custkey, c_name, coalesce(n_name, '') as region from customer c left join nation n on c.c_nationkey = n.n_nationkey and n.n_regionkey <> 2
where coalesce(n_name, '') = '' and c_mktsegment ilike '%build%'""")
def filter_unknown_sentinel(spark, d):
    known = table(spark, d, "nation").where("n_regionkey <> 2")
    rows = table(spark, d, "customer").join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = catalog.filtered(rows, text.matches_filter(F.col("n_name"), text.UNKNOWN), text.matches_filter(F.col("c_mktsegment"), "build"))
    return rows.select("c_custkey", "c_name", F.coalesce("n_name", F.lit("")).alias("region"))


@query("""select d.doc_id, case when l.quality = 1 then case when l.toxic = 0 then 'confirmed' else 'review' end when l.quality = 0 then 'excluded' else 'pending' end as ai_status,
(l.quality is null) as in_review from documents d left join labels l on d.doc_id = l.doc_id""")
def relevance_tri_state(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    relevant = F.col("quality") == 1
    shown = catalog.relevance("review", relevant, F.lit(False), F.lit("open"))
    return rows.select("doc_id", catalog.judged_label(relevant, F.lit(False), F.col("toxic") == 0).alias("ai_status"), shown.alias("in_review"))


@query(NOTICES + """select o_orderkey, case when failed > 0 then case when files > 0 then 'partial' else 'failed' end when files > 0 then case when attachments < refs then 'partial' else 'downloaded' end else 'not_downloaded' end as download_status,
files > 0 and refs > attachments as filter_partial from notices""")
def download_status_label(spark, d):
    rows, counts = notices(spark, d), [F.col(c) for c in ("files", "attachments", "refs", "failed")]
    return rows.select("o_orderkey", catalog.download_label(*counts).alias("download_status"), catalog.download_filter("partial", *counts).alias("filter_partial"))


@query("""with a as (select o_orderkey, case when o_orderstatus = 'F' then cast(round(o_totalprice * 100) as bigint) end as contract, case when o_orderkey % 3 = 0 then cast(round(o_totalprice * 90) as bigint) end as award, case when o_orderkey % 2 = 0 then cast(round(o_totalprice * 110) as bigint) end as budget from orders)
select o_orderkey, coalesce(contract, award, budget) as amount_minor, case when contract is not null then 'contract' when award is not null then 'award' when budget is not null then 'budget' else '' end as amount_type from a""")
def primary_amount(spark, d):
    price = F.col("o_totalprice")
    present = {
        "contract_amount_minor": F.when(F.col("o_orderstatus") == "F", F.round(price * 100).cast("long")),
        "award_amount_minor": F.when(F.col("o_orderkey") % 3 == 0, F.round(price * 90).cast("long")),
        "budget_amount_minor": F.when(F.col("o_orderkey") % 2 == 0, F.round(price * 110).cast("long")),
    }
    amount, kind = money.primary(present)
    return table(spark, d, "orders").select("o_orderkey", amount.alias("amount_minor"), kind.alias("amount_type"))


@query("""with f as (select l_orderkey, string_agg(l_shipmode, ' | ' order by l_shipmode) as paths, count(*) as n from (select l_orderkey, l_returnflag || l_linenumber::varchar as l_shipmode from lineitem where l_linestatus = 'F') group by l_orderkey)
select o_orderkey, coalesce(f.n, 0) as n_files, coalesce(f.paths, '') as paths,
  (case when o_totalprice < 0 then '-' else '' end) || (cast(round(o_totalprice * 100) as bigint) // 100)::varchar || '.' || lpad((cast(round(o_totalprice * 100) as bigint) % 100)::varchar, 2, '0') as yuan
from orders o left join f on f.l_orderkey = o.o_orderkey""")
def current_results(spark, d):
    path = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    files = table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(catalog.joined_text(path).alias("paths"), F.count("*").alias("n"))
    rows = table(spark, d, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_files"), F.coalesce("paths", F.lit("")).alias("paths"), money.yuan(F.round(F.col("o_totalprice") * 100).cast("long")).alias("yuan"))


@query("""select l.l_orderkey, l.l_partkey, l.l_linenumber, strftime(o.o_orderdate, '%Y-%m-%d') as day from lineitem l join orders o on l.l_orderkey = o.o_orderkey
join (select l_orderkey, l_partkey, max(l_shipdate) as last from lineitem group by all) c on c.l_orderkey = l.l_orderkey and c.l_partkey = l.l_partkey and c.last = l.l_shipdate where l.l_linestatus = 'F' and l.l_returnflag = 'A'""")
def verified_current(spark, d):
    lines = table(spark, d, "lineitem")
    current = lines.groupBy("l_orderkey", "l_partkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    kept = lines.where("l_linestatus = 'F' and l_returnflag = 'A'").join(current, ["l_orderkey", "l_partkey", "l_shipdate"], "left_semi")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return kept.join(orders, "l_orderkey").select("l_orderkey", "l_partkey", "l_linenumber", "day")


@query("""with f as (select l_orderkey, l_partkey, max(l_linestatus) as got from lineitem where l_quantity > 25 group by all)
select o.o_orderkey, l.l_partkey, l.l_linenumber,
  case when coalesce(f.got = 'F', false) then 'downloaded' else case l.l_returnflag when 'R' then 'failed' when 'A' then 'blocked' else case when l.l_partkey is null then 'no_link' else 'not_downloaded' end end end as state,
  case when coalesce(f.got = 'F', false) then '' when l.l_partkey is null then 'no direct link was found; see the notice' when o.o_orderstatus <> 'F' then 'the source isn''t verified; check by hand' else 'the link was found, its response isn''t verified' end as reason
from orders o left join lineitem l on l.l_orderkey = o.o_orderkey left join f on f.l_orderkey = l.l_orderkey and f.l_partkey = l.l_partkey""")
def links_outer(spark, d):
    lines = table(spark, d, "lineitem")
    got = lines.where("l_quantity > 25").groupBy("l_orderkey", "l_partkey").agg(F.max("l_linestatus").alias("got"))
    links = lines.join(got, ["l_orderkey", "l_partkey"], "left").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "got")
    rows = table(spark, d, "orders").join(links, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    there, done = F.col("l_partkey").isNotNull(), F.coalesce(F.col("got") == "F", F.lit(False))
    ref = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "blocked")
    return rows.select("o_orderkey", "l_partkey", "l_linenumber", catalog.link_state(there, done, ref).alias("state"), catalog.link_reason(there, done, F.col("o_orderstatus") == "F", F.lit("")).alias("reason"))


@query("""with r as (select doc_id, source, sha256(text) as k from documents), f as (select k, min(doc_id) as canon from r group by k)
select r.doc_id as alias_identity, r.source as alias_name, f.canon as canonical_identity, c.source as canonical_name from r join f using (k) join r c on c.doc_id = f.canon where r.doc_id <> f.canon""")
def alias_self_join(spark, d):
    docs = table(spark, d, "documents")
    pairs = catalog.aliases(docs, "doc_id", F.sha2("text", 256), F.col("doc_id"))
    return catalog.named_both_ways(pairs, docs, "doc_id", "source")


@query("select e.event_id, e.event_type, e.user_id from events e join (select event_type, max(user_id) as m from events group by event_type) x on e.event_type = x.event_type and e.user_id = x.m")
def latest_coverage(spark, d):
    return catalog.latest_per_group(table(spark, d, "events"), "event_type", "user_id").select("event_id", "event_type", "user_id")


@query("select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_linestatus = 'F' and l.l_returnflag <> 'R')")
def orders_without_eligible(spark, d):
    eligible = table(spark, d, "lineitem").where("l_linestatus = 'F' and l_returnflag <> 'R'")
    return catalog.without_match(table(spark, d, "orders"), "o_orderkey", eligible, "l_orderkey").select("o_orderkey")


_SOURCES = ("click", "view", "purchase", "error", "signup", "feed")


@query("""with s as (select unnest(['click', 'view', 'purchase', 'error', 'signup', 'feed']) as source), f as (select event_type, case when max(value) > 100 then 'running' else 'ok' end as status from events group by event_type)
select s.source, case when f.status is null then 'not_started' when f.status = 'running' then 'interrupted' else f.status end as status from s left join f on f.event_type = s.source""")
def expected_sources_status(spark, d):
    found = table(spark, d, "events").groupBy("event_type").agg(F.when(F.max("value") > 100, "running").otherwise("ok").alias("status"))
    sources = spark.createDataFrame([(x,) for x in _SOURCES], "source string")
    return coverage.expected(sources, found.withColumnRenamed("event_type", "source"), "source", running=False).select("source", "status")


@query("""with seen as (select case when coalesce(c_mktsegment, '') = '' then '__unknown__' else c_mktsegment end as value, count(*) as n from orders o join customer c on o.o_custkey = c.c_custkey group by 1),
fixed as (select unnest(['BUILDING', 'SPACECRAFT', '__unknown__']) as value, 0 as n)
select value, sum(n)::bigint as n from (select * from seen union all select * from fixed) group by value""")
def facet_counts(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return catalog.facet(rows, "c_mktsegment", ("BUILDING", "SPACECRAFT"))


@query("select count(*) filter (l.quality = 1) as matched, count(*) filter (l.quality = 0) as rejected, count(*) filter (l.quality is null) as pending from documents d left join labels l on d.doc_id = l.doc_id")
def review_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.agg(F.count_if(F.col("quality") == 1).alias("matched"), F.count_if(F.col("quality") == 0).alias("rejected"), F.count_if(F.col("quality").isNull()).alias("pending"))


_RUNS = "select date_trunc('day', ts) as run, event_type as source, count(*) as notices, case when max(value) > 60 then 'running' else 'ok' end as status, max(ts) as updated_at from events group by 1, 2"


@query(f"select sum(greatest(notices, 0))::bigint as notices, count(*) as sources, count(*) filter (status not in ('running', 'queued', 'waiting_verification')) as done, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') as last_update, count(*) filter (status not in ('running', 'queued', 'waiting_verification')) < count(*) as stale from ({_RUNS})")
def progress_model(spark, d):
    runs = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("run"), F.col("event_type").alias("source")).agg(F.count("*").alias("notices"), F.when(F.max("value") > 60, "running").otherwise("ok").alias("status"), F.max("ts").alias("updated_at"))
    found = coverage.progress(runs, F.lit("2100-01-01 00:00:00").cast("timestamp"))
    return found.withColumn("last_update", F.date_format("last_update", "yyyy-MM-dd HH:mm:ss"))


@query("""with p as (select event_type, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month, 1 as pages, event_id % 3 as notices, event_id % 97 <> 0 as reached_start, true as reached_end, value > 100 as truncated, case when event_type = 'error' and event_id % 50 = 0 then 1 else 0 end as blocked, 0 as failed from events),
r as (select event_type, month, min(day) as first_date, max(day) as last_date, sum(pages)::bigint as pages, sum(notices)::bigint as notices, bool_and(reached_start) as rs, bool_and(reached_end) as re, bool_or(truncated) as tr, sum(blocked)::bigint as blocked, sum(failed)::bigint as failed from p group by event_type, month)
select event_type, month, first_date, last_date, pages, notices, blocked, case when tr or not rs or not re or blocked > 0 or failed > 0 then 'partial' when notices > 0 then 'ok' else 'empty' end as status from r""")
def coverage_rollup(spark, d):
    c = F.col
    parts = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM").alias("run"), F.lit(1).cast("long").alias("pages"), (c("event_id") % 3).alias("notices"), (c("event_id") % 97 != 0).alias("reached_start"), F.lit(True).alias("reached_end"), (c("value") > 100).alias("truncated"), F.when((c("event_type") == "error") & (c("event_id") % 50 == 0), 1).otherwise(0).cast("long").alias("blocked"), F.lit(0).cast("long").alias("failed"))
    rows = coverage.rollup(parts, "event_type", "run")
    state = coverage.status(c("notices"), c("reached_start"), c("reached_end"), c("truncated"), c("blocked"), c("failed"))
    return rows.select("event_type", c("run").alias("month"), "first_date", "last_date", "pages", "notices", "blocked", state.alias("status"))


@query("select case when o_orderstatus = 'O' then 'cataloged' when o_orderstatus = 'F' then 'excluded' else 'review' end as outcome, count(*) as n, case when count(*) filter (o_orderpriority = '1-URGENT') > 0 then 2 else 0 end::bigint as exit_code from orders group by 1")
def run_summary(spark, d):
    outcome = F.when(F.col("o_orderstatus") == "O", "cataloged").when(F.col("o_orderstatus") == "F", "excluded").otherwise("review")
    rows = table(spark, d, "orders").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("gaps"))
    return rows.select("outcome", "n", coverage.exit_code(F.lit(0), F.col("gaps")).cast("long").alias("exit_code"))


@query("""with c as (select o_orderkey, l_partkey, case when l_returnflag = 'A' then 'official_notice' when l_returnflag = 'N' then 'intention_group' else 'official_attachment' end as kind from orders join lineitem on l_orderkey = o_orderkey group by all),
r as (select o_orderkey, kind, l_partkey::varchar as name, case kind when 'intention_group' then 2 when 'official_notice' then 3 else 4 end::bigint as rank from c)
select o_orderkey, place, rank as kind, name from (select *, row_number() over (partition by o_orderkey order by rank, name) as place from r) where place <= 3""")
def top_candidates(spark, d):
    from ..operators.provenance import KINDS

    kind = F.when(F.col("l_returnflag") == "A", KINDS[2]).when(F.col("l_returnflag") == "N", KINDS[1]).otherwise(KINDS[3])
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("name"), kind.alias("kind_name")).distinct()
    order = F.array_position(F.array(*(F.lit(x) for x in KINDS)), F.col("kind_name"))
    return catalog.candidates_in_order(found, "o_orderkey", 3, order, "name").withColumn("place", F.col("place").cast("long"))


@query("""with w as (select event_type, min(ts)::date as a, max(ts)::date as b from events where ts is not null group by event_type),
s as (select event_type, a, b, unnest(range(0, (b - a) // 7 + 1)) as n from w)
select event_type, strftime(a + (7 * n)::int, '%Y-%m-%d') as first, strftime(least(a + (7 * n + 6)::int, b), '%Y-%m-%d') as last from s""")
def date_windows(spark, d):
    """Windows of a week over the days that each type of event spans."""
    span = table(spark, d, "events").where("ts is not null").groupBy("event_type").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    rows = dates.windows_of(span, "a", "b", 7)
    return rows.select("event_type", *(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first", "last")))


@query("""with m as (select o_orderkey, case when o_orderkey % 2 = 0 then '' else '-' end as s, printf('%.2f', o_totalprice) as t, o_orderkey % 5 = 0 as big from orders)
select o_orderkey, (round(t::decimal(38,6) * case when big then 1000000 else 100 end))::bigint as amount_minor,
 ((round(t::decimal(38,6) * case when big then 1000000 else 100 end))::bigint // 100)::varchar || '.' || lpad(((round(t::decimal(38,6) * case when big then 1000000 else 100 end))::bigint % 100)::varchar, 2, '0') as yuan from m""")
def money_minor_and_yuan(spark, d):
    shown = F.concat(F.lit("预算金额："), F.format_number("o_totalprice", 2), F.when(F.col("o_orderkey") % 5 == 0, F.lit("万元")).otherwise(F.lit("元")))
    rows = table(spark, d, "orders").select("o_orderkey", shown.alias("shown"))
    rows = money.with_amounts(rows, F.col("shown"), {"amount_minor": ("预算金额", "采购预算")})
    return rows.select("o_orderkey", "amount_minor", money.yuan(F.col("amount_minor")).alias("yuan"))
