"""Queries of writes: upserts, merges, versions, changes, duplicates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import upsert
from ..shared import shared_dir
from .registry import query, table


@query("""select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events) where rn = 1""")
def upsert_latest_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("arrival"))
    return upsert.latest_wins(rows, ["user_id", "event_type"], ["arrival"]).drop("arrival")


@query("""with o as (select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events where event_type in ('view', 'click') group by user_id),
n as (select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events where event_type not in ('view', 'click') group by user_id)
select coalesce(n.user_id, o.user_id) as user_id, case when n.user_id is not null then n.event_id else o.event_id end as event_id, case when o.user_id is not null then o.value else n.value end as value
from o full join n on o.user_id = n.user_id""")
def upsert_keeping_columns(spark, d):
    """What users did is taken over from one feed to the other; the value stays as first known."""
    rows = table(spark, d, "events").withColumn("seen", F.col("event_type").isin("view", "click")).select("user_id", "event_id", "value", "seen", F.col("event_id").alias("arrival"))
    last = lambda part: upsert.latest_wins(part.drop("seen"), ["user_id"], ["arrival"]).drop("arrival")
    return upsert.upserted(last(rows.where("seen")), last(rows.where("not seen")), ["user_id"], keep=["value"])


_SIDES = """with s as (select l_orderkey, l_partkey, l_linestatus as side, min(l_suppkey) as supp, max(l_returnflag) as flag, max(l_quantity) as q from lineitem group by all),
o as (select l_orderkey, l_partkey, supp % 2 as sha, case when q > 20 then 'path' end as path, case flag when 'R' then 'delivered' when 'A' then 'review' else 'downloaded' end as status from s where side = 'F'),
n as (select l_orderkey, l_partkey, supp % 2 as sha, case when q > 30 then 'new' end as path, case flag when 'R' then 'downloaded' when 'A' then 'verified' else 'failed' end as status from s where side = 'O')
"""


@query(_SIDES + """select coalesce(o.l_orderkey, n.l_orderkey) as l_orderkey, coalesce(o.l_partkey, n.l_partkey) as l_partkey, coalesce(n.sha, o.sha)::varchar as sha256,
 case when n.sha is null then o.path when o.sha = n.sha then coalesce(n.path, o.path) else n.path end as delivery_path,
 case when n.sha is null then o.status when o.sha = n.sha and o.status in ('delivered', 'review') and n.status in ('downloaded', 'verified') then o.status else n.status end as status
from o full join n on o.l_orderkey = n.l_orderkey and o.l_partkey = n.l_partkey""")
def merge_sticky_status(spark, d):
    """Finished lines are the files that are there, open ones the new downloads."""
    sides = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linestatus").agg(F.min("l_suppkey").alias("supp"), F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("q"))
    pick = lambda side, a, b, c, least, path: sides.where(F.col("l_linestatus") == side).select("l_orderkey", "l_partkey", (F.col("supp") % 2).cast("string").alias("sha256"), F.when(F.col("q") > least, path).alias("delivery_path"), F.when(F.col("flag") == "R", a).when(F.col("flag") == "A", b).otherwise(c).alias("status"))
    return upsert.merged_artifacts(pick("F", "delivered", "review", "downloaded", 20, "path"), pick("O", "downloaded", "verified", "failed", 30, "new"), ["l_orderkey", "l_partkey"])


@query("""with o as (select l_orderkey, case max(l_returnflag) when 'R' then 'downloaded' when 'N' then 'failed' else 'restricted' end as status from lineitem where l_linestatus = 'F' group by l_orderkey),
n as (select l_orderkey, case max(l_returnflag) when 'R' then 'available' else 'verified' end as status from lineitem where l_linestatus = 'O' group by l_orderkey)
select coalesce(o.l_orderkey, n.l_orderkey) as l_orderkey, case when n.status is null then o.status when n.status in ('available', 'discovered') and coalesce(o.status in ('downloaded', 'failed', 'blocked'), false) then o.status else n.status end as status
from o full join n on o.l_orderkey = n.l_orderkey""")
def merge_sticky_refs(spark, d):
    lines = table(spark, d, "lineitem")
    flag = F.max("l_returnflag")
    old = lines.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.when(flag == "R", "downloaded").when(flag == "N", "failed").otherwise("restricted").alias("status"))
    new = lines.where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.when(flag == "R", "available").otherwise("verified").alias("status"))
    return upsert.merged_refs(old, new, ["l_orderkey"])


@query("select conv_id, role, sha256(text) as sha256, min(turn) as first_seen, max(turn) as last_seen, count(*) as sightings from conversations group by 1, 2, 3")
def version_first_seen(spark, d):
    return upsert.versions(table(spark, d, "conversations").withColumn("sha256", F.sha2("text", 256)), ["conv_id", "role"], "sha256", "turn")


@query("select c.conv_id, c.turn, c.role, sha256(c.text) as sha256, d.source from conversations c join documents d on c.conv_id = d.doc_id")
def manifest_versions(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "source")
    return table(spark, d, "conversations").join(docs, "conv_id").select("conv_id", "turn", "role", F.sha2("text", 256).alias("sha256"), "source")


@query("""with o as (select doc_id, sha256(text) as s from documents), n as (select case when doc_id % 7 = 0 then -1 - doc_id else doc_id end as doc_id, sha256(case when doc_id % 5 = 0 then trim(text) || '.' else text end) as s from documents where doc_id % 11 <> 0)
select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' when o.s is not distinct from n.s then 'unchanged' else 'changed' end as change from o full join n on o.doc_id = n.doc_id""")
def change_detection(spark, d):
    """Documents, and a second scan of them: some are gone, some have another id, some another text."""
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    old = docs.select("doc_id", F.sha2("text", 256).alias("sha256"))
    text = F.when(n % 5 == 0, F.concat(F.trim("text"), F.lit("."))).otherwise(F.col("text"))
    new = docs.where(n % 11 != 0).select(F.when(n % 7 == 0, -1 - n).otherwise(n).alias("doc_id"), F.sha2(text, 256).alias("sha256"))
    return upsert.changes(old, new, "doc_id", "sha256")


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by sha256(text)")
def dedup_text_sha(spark, d):
    return upsert.first_of_equal(table(spark, d, "documents"), F.sha2("text", 256), "doc_id")


@query("""with b as (select doc_id, lang from documents where text ilike '%and%'), x as (select doc_id, lang from documents where n_chars > 3000 and doc_id not in (select doc_id from b)), r as (select * from x order by doc_id limit 40)
select *, 'baseline' as recall_origin, (select count(*) > 40 from x) as truncated from b union all select *, 'broad', (select count(*) > 40 from x) from r""")
def recall_two_phase(spark, d):
    from ..functions import text
    from ..sources import readers

    docs = table(spark, d, "documents")
    baseline = docs.where(text.contains_text(F.col("text"), "and")).select("doc_id", "lang")
    return readers.recall(baseline, docs.where("n_chars > 3000").select("doc_id", "lang"), "doc_id", 40, "doc_id")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn from events) where rn = 1")
def streamed_upsert(spark, d):
    """The events as a stream, merged batch by batch into a table; it ends as the batch form does."""
    from ..streaming import incremental

    place = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema  # a pattern: a source takes a folder or a pattern, never one file
    rows = incremental.stream_of(spark, f"{d}/events.parque[t]", schema).select("user_id", "event_type", "event_id", "value")
    incremental.merge_into(rows, f"{place}/table", f"{place}/offsets", ["user_id", "event_type"], ["event_id"]).awaitTermination()
    return incremental.latest(spark, f"{place}/table")
