"""Migrations of older tables, their publishing, and writes with null keys."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import migrations, upsert

def now():
    return F.lit("2026-01-01").cast("timestamp")


@pytest.fixture
def older(spark):
    notices = spark.createDataFrame(
        [("n:1", "http://a.test", True, "delivered", None), ("n:2", "http://a.test", True, "delivered", None), ("n:3", "https://a.test", False, "review", None), ("n:4", "https://a.test", True, "review", '{"scan_sha256": "x"}'), ("n:5", None, None, "metadata_ready", None), (None, None, None, None, None)],
        "identity string, publication_url string, origin_verified boolean, status string, metadata_json string",
    )
    artifacts = spark.createDataFrame(
        [("n:1", "HTTP://a.test/f", "s1", True, True, "allowed", "delivered", None), ("n:2", "https://a.test/g", "s2", True, True, "allowed", "delivered", "late"), ("n:3", "https://a.test/h", "s3", None, None, None, "review", None)],
        "notice_identity string, source_url string, sha256 string, delivery_eligible boolean, origin_verified boolean, gate_status string, status string, error string",
    )
    return {"notices": notices, "artifacts": artifacts, "versions": artifacts.where("sha256 = 's2'").withColumn("error", F.lit("kept"))}


def shown(tables):
    return {name: sorted(map(str, rows.collect())) for name, rows in tables.items()}


def test_migrations(older):
    found = migrations.migrated(older, now())
    notices = {r.identity: (r.status, r.origin_verified) for r in found["notices"].collect()}
    assert notices == {"n:1": ("unresolved_official_source", False), "n:2": ("delivered", True), "n:3": ("legacy_unverified", False), "n:4": ("review", True), "n:5": ("metadata_ready", None), None: (None, None)}
    artifacts = {r.sha256: r for r in found["artifacts"].collect()}
    assert (artifacts["s1"].status, artifacts["s1"].gate_code, artifacts["s1"].error, artifacts["s1"].delivery_eligible) == (migrations.REVOKED, migrations.REVOKED_CODE, migrations.REVOKED_MESSAGE, False)
    assert (artifacts["s3"].status, artifacts["s3"].gate_status, artifacts["s3"].source_role) == (migrations.LEGACY_DELIVERED, "legacy_unverified", "unknown")
    versions = {r.sha256: r for r in found["versions"].collect()}
    assert set(versions) == {"s1", "s2", "s3"} and versions["s2"].error == "kept" and versions["s2"].first_seen_at is None and versions["s1"].first_seen_at is not None
    assert versions["s1"].status == migrations.REVOKED
    # once more, nothing changes
    assert shown(migrations.migrated(found, now())) == shown(found)


def test_store(spark, older, tmp_path):
    store = migrations.Store(spark, f"file://{tmp_path}/store")
    assert store.current() is None
    with pytest.raises(ValueError):
        store.migrate(now())
    store.publish(older, [])
    before = shown(store.tables())

    def fails(tables, when):
        return tables | {"notices": tables["notices"].withColumn("status", F.raise_error(F.lit("no")).cast("string"))}

    with pytest.raises(Exception, match="no"):
        store.migrate(now(), (*migrations.MIGRATIONS, ("bad", fails)))
    assert shown(store.tables()) == before and store.current()["applied"] == []
    assert store.migrate(now()) == [name for name, _ in migrations.MIGRATIONS]
    after = shown(store.tables())
    assert after == shown(migrations.migrated(older, now())) and store.migrate(now()) == [] and shown(store.tables()) == after


def test_null_keys_are_keys(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    both = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert both(upsert.upserted(make([(1, "a")]), make([(1, "b"), (None, "n")]), ["k"])) == [(1, "b"), (None, "n")]
    assert both(upsert.upserted(make([(1, "a"), (None, "m")]), make([(None, "n"), (2, "c")]), ["k"])) == [(1, "a"), (2, "c"), (None, "n")]
    assert both(upsert.upserted(make([(None, "m")]), make([(None, None)]), ["k"], keep=["v"])) == [(None, "m")]
    assert both(upsert.upserted(make([(None, "m")]), make([(None, None)]), ["k"])) == [(None, None)]
    assert both(upsert.changes(make([(None, "m"), (1, "a")]), make([(None, "m"), (2, None)]), "k", "v")) == [(1, "removed"), (2, "added"), (None, "unchanged")]
    refs = upsert.merged_refs(make([(None, "failed")]).withColumnRenamed("v", "status"), make([(None, "available")]).withColumnRenamed("v", "status"), ["k"])
    assert both(refs) == [(None, "failed")]
    verdict = upsert.snapshot(make([(None, "old")]), make([(None, "new")]), ["k"], ["v"])
    assert both(verdict) == [(None, "new")]
