"""The catalogue as one object, and criteria."""

import pytest
from pyspark.sql import functions as F

from quillspark import model
from quillspark.api import Catalog
from quillspark.operators import upsert
from quillspark.plans.criteria import Criteria, checked_thresholds


def filled(spark, schema, rows, key="notice_identity"):
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="module")
def catalogue(spark):
    notices = filled(spark, model.NOTICES, [
        {"source": "s", "external_id": "1", "title": "防火墙采购", "buyer": "第一中学", "published_at": "2026-01-02", "region": "吉林省", "status": "review", "metadata_json": '{"query_id": "q"}', "origin_verified": True, "source_role": "official", "url": "https://a.test/1"},
        {"source": "s", "external_id": "2", "title": "=100%办公", "buyer": None, "published_at": "2026-01-01", "status": "excluded", "metadata_json": "broken", "url": "https://a.test/2"},
        {"source": "s", "external_id": "3", "title": "别名", "published_at": "2026-01-03", "status": "alias", "metadata_json": '{"query_id": "q"}', "url": "https://a.test/3"},
    ]).withColumn("identity", model.identity(F.col("source"), F.col("external_id")))
    fields = filled(spark, model.FIELDS, [{"notice_identity": "s:1", "event_type": "中标公告", "budget_amount_minor": 90_000_000, "award_amount_minor": 88_000_000, "contract_amount_minor": 87_500_000, "city": "长春市", "published_at": "2026-01-02"}])
    verdicts = filled(spark, model.CLASSIFICATIONS, [{"notice_identity": "s:1", "relevant": True, "confidence": 0.9, "industry": "教育", "needs_review": False, "ai_confirmed": True, "categories": ["安全设备"], "evidence": ["防火墙"]}])
    refs = filled(spark, model.REFS, [{"notice_identity": "s:1", "source_url": "https://a.test/f.pdf", "status": "downloaded"}, {"notice_identity": "s:1", "source_url": "https://a.test/g.pdf", "status": "failed", "error": "timeout"}])
    art = {"notice_identity": "s:1", "source_url": "https://a.test/f.pdf", "sha256": "new", "origin_verified": True, "gate_status": "allowed", "source_role": "official", "delivery_eligible": True, "delivery_path": "p", "status": "delivered"}
    artifacts = filled(spark, model.ARTIFACTS, [art])
    versions = filled(spark, model.VERSIONS, [art, art | {"sha256": "old"}])
    coverage = filled(spark, model.COVERAGE, [{"run_id": "r", "source": "s", "status": "ok"}])
    return Catalog(notices, fields, verdicts, refs, artifacts, versions, coverage)


def ids(found):
    return [r["identity"] for r in found[0].collect()]


def test_filters(catalogue):
    page, totals = catalogue.list_notices(page_size=1)
    assert [r["identity"] for r in page.collect()] == ["s:3"] and totals.first() == (3, 3)
    assert ids(catalogue.list_notices(query="100%")) == ["s:2"] and ids(catalogue.list_notices(query="%")) == ["s:2"]
    assert ids(catalogue.list_notices(query_id="q")) == ["s:1"]
    assert ids(catalogue.list_notices(city="__unknown__")) == ["s:3", "s:2"]
    assert ids(catalogue.list_notices(relevance="review")) == []
    assert ids(catalogue.list_notices(relevance="excluded")) == ["s:2"]
    assert ids(catalogue.list_notices(download_status="failed", query="防火墙", notice_type="中标", industry="教育", category="安全设备", city="长春", status="review", source="s", date_from="2026-01-02", date_to="2026-01-02", relevance="relevant")) == ["s:1"]
    with pytest.raises(ValueError):
        catalogue.list_notices(relevance="x")


def test_rows(catalogue):
    row = catalogue.rows().where("identity = 's:1'").first()
    assert (row.amount_minor, row.amount_type, row.amount, row.download_status, row.ai_status) == (87_500_000, "contract", "875000.00", "partial", "confirmed")


def test_exports(catalogue, spark, tmp_path):
    assert sorted((r.identity, r.state) for r in catalogue.links().collect()) == [("s:1", "downloaded"), ("s:1", "failed"), ("s:2", "no_link"), ("s:3", "no_link")]
    assert catalogue.manifest().count() == 2 and [r.sha256 for r in catalogue.manifest(verified=True).collect()] == ["new"]
    assert catalogue.export(str(tmp_path / "x")).first() == (3, 4, 2)
    assert "'=100%办公" in {r.title for r in spark.read.csv(str(tmp_path / "x"), header=True).collect()}


def test_upserts_keep_the_source(catalogue, spark):
    new = catalogue.notices.where("identity = 's:1'").withColumn("title", F.lit("new")).withColumn("source", F.lit("other"))
    got = catalogue.upserted(new).notices
    assert got.count() == 3 and got.where("identity = 's:1'").first()["title"] == "new" and got.where("identity = 's:1'").first()["source"] == "s"


def test_snapshots_and_budgets(spark):
    versions = spark.createDataFrame([("n", "u", "1", None), ("n", "u", "2", True)], "a string, b string, sha string, relevant boolean")
    verdicts = spark.createDataFrame([("n", "u", "1", False)], versions.schema)
    assert sorted((r.sha, r.relevant) for r in upsert.snapshot(versions, verdicts, ["a", "b", "sha"], ["relevant"]).collect()) == [("1", False), ("2", True)]
    rows = spark.createDataFrame([("s", i) for i in range(5)], "g string, i int")
    assert upsert.within_budget(rows, "g", "i", 2).where("granted").count() == 2
    assert upsert.projected(rows, {"x": ("nothing", "g"), "y": ("none",)}).first() == ("s", None)


def test_criteria(spark):
    c = Criteria("2026-01-01", "2026-01-31", province="吉林省", industry="教育", keyword="教育")
    assert c.terms[0] == "教育" and "大学" in c.terms and c.region == "吉林省"
    assert c.supported({"a": ("province", "industry", "keyword"), "b": ("province",)}) == {"a": "ok", "b": "industry"}
    rows = spark.createDataFrame([("2026-01-05", "吉林省-长春市", "某大学采购", "", "x"), ("2026-02-05", "吉林省", "某大学采购", "", "x"), ("2026-01-05", "吉林省", "办公", None, None)], "d string, r string, t string, b string, k string")
    for condition in c.conditions(*(F.col(x) for x in "drtbk")):
        rows = rows.where(condition)
    assert rows.count() == 1
    for bad in ({"mode": "x"}, {"max_candidates": 5}, {"city": "长春市"}, {"end_date": "2025-01-01"}, {"start_date": "x"}):
        with pytest.raises(ValueError):
            Criteria(**{"start_date": "2026-01-01", "end_date": "2026-01-31"} | bad)
    with pytest.raises(ValueError):
        checked_thresholds(0.9, 0.5)


def test_current_results_have_all_amounts_in_yuan(catalogue):
    row = catalogue.current().where("identity = 's:1'").first()
    assert (row.budget_amount_yuan, row.award_amount_yuan, row.contract_amount_yuan, row.max_price_yuan) == ("900000.00", "880000.00", "875000.00", "")
    assert catalogue.current().count() == 2


def test_exact_filters(catalogue):
    assert ids(catalogue.list_notices(notice_type="中标", exact=True)) == [] and ids(catalogue.list_notices(notice_type="中标公告", exact=True)) == ["s:1"]
    assert ids(catalogue.list_notices(city="__unknown__", exact=True)) == ["s:3", "s:2"] and ids(catalogue.list_notices(relevance="relevant_pending")) == ["s:3", "s:1"]
