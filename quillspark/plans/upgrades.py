"""Queries over migrations: orders stand for notices of an older catalogue, their lines for files of all kinds and standings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import migrations
from .registry import query, table


def older(spark, d):
    """The tables as an older version left them; the first two lines of an order are known as versions already."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_partkey").alias("l_partkey"))
    url = F.concat(F.when(n % 4 == 0, "http").otherwise("https"), F.lit("://a.test/"), F.col("l_orderkey").cast("string"), F.lit("/"), n.cast("string"))
    artifacts = lines.select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("notice_identity"), url.alias("source_url"), F.col("l_partkey").cast("string").alias("sha256"),
        (flag == "N").alias("delivery_eligible"), (flag == "N").alias("origin_verified"), F.when(flag == "N", "allowed").when(flag == "R", "rejected").alias("gate_status"),
        F.when(flag == "N", "delivered").when(flag == "A", "review").otherwise("downloaded").alias("status"), F.when(n == 4, "old").alias("error"), n.alias("line"),
    )
    orders, key = table(spark, d, "orders"), F.col("o_orderkey")
    notices = orders.select(
        F.concat(F.lit("o:"), key.cast("string")).alias("identity"), F.concat(F.when(key % 3 == 0, "HTTP").otherwise("https"), F.lit("://a.test/"), key.cast("string")).alias("publication_url"), (key % 2 == 0).alias("origin_verified"),
        F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "review").otherwise("metadata_ready").alias("status"), F.when(key % 5 == 0, '{"scan_sha256": "x"}').alias("metadata_json"),
    )
    return {"notices": notices, "artifacts": artifacts.drop("line"), "versions": artifacts.where("line <= 2").drop("line")}


_OLDER = """with l as (select l_orderkey, l_linenumber as line, max(l_returnflag) as flag, max(l_partkey)::varchar as sha256 from lineitem group by all),
a as (select 'o:' || l_orderkey as id, sha256, line, flag, line % 4 = 0 and flag = 'N' as gone, case when line % 4 = 0 then 'http' else 'https' end || '://a.test/' || l_orderkey || '/' || line as source_url from l),
good as (select distinct id from a where flag = 'N' and not gone), held as (select distinct id from a)
"""
_MESSAGE = migrations.REVOKED_MESSAGE


@query(_OLDER + f"""select id as notice_identity, source_url, sha256, flag = 'N' and not gone as delivery_eligible, case when gone then 'revoked_insecure_transport' when flag = 'N' then 'allowed' when flag = 'R' then 'rejected' else 'legacy_unverified' end as gate_status,
case when gone then 'revoked_insecure_transport' when flag = 'N' then 'delivered' when flag = 'A' then 'legacy_delivered_unverified' else 'downloaded' end as status,
case when gone and line = 4 then 'old；{_MESSAGE}' when gone then '{_MESSAGE}' when line = 4 then 'old' end as error, line > 2 as filled from a""")
def migrated_versions(spark, d):
    """All versions after the migrations: known ones and those filled in from current files, what came over HTTP revoked."""
    found = migrations.migrated(older(spark, d), F.lit("2026-01-01").cast("timestamp"))["versions"]
    return found.select("notice_identity", "source_url", "sha256", "delivery_eligible", "gate_status", "status", "error", F.col("first_seen_at").isNotNull().alias("filled"))


@query(_OLDER + """, n as (select 'o:' || o_orderkey as id, o_orderkey % 3 = 0 as plain, o_orderkey % 2 = 0 as verified, o_orderkey % 5 = 0 as scanned, case o_orderstatus when 'F' then 'delivered' when 'O' then 'review' else 'metadata_ready' end as status from orders),
r as (select n.*, g.id is null as none, s.id is null as bare, verified and plain and g.id is null as gone from n left join good g on n.id = g.id left join held s on n.id = s.id)
select id as identity, verified and not gone as origin_verified, case when gone then 'unresolved_official_source' when status in ('delivered', 'review') and none and not (status = 'review' and verified and scanned and bare) then 'legacy_unverified' else status end as status from r""")
def migrated_notices(spark, d):
    """Notices after the migrations, as their files allow."""
    return migrations.migrated(older(spark, d), F.lit("2026-01-01").cast("timestamp"))["notices"].select("identity", "origin_verified", "status")
