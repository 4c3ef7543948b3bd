"""Operators, sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark import model
from quillspark.operators import catalog, places, provenance, upsert
from quillspark.sources import readers, sinks
from quillspark.streaming import incremental


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns or frame.columns).collect())


def test_upserting_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = upsert.upserted(old, new, ["k"])
    assert rows(once) == [(1, "a"), (2, "c"), (3, "d")] == rows(upsert.upserted(once, new, ["k"]))


def test_other_content_resets_an_artifact(spark):
    old = spark.createDataFrame([("u", "old", "p", "delivered"), ("w", "same", "q", "delivered")], "k string, sha256 string, delivery_path string, status string")
    new = spark.createDataFrame([("u", "new", None, "downloaded"), ("w", "same", None, "verified")], old.schema)
    assert rows(upsert.merged_artifacts(old, new, ["k"])) == [("u", "new", None, "downloaded"), ("w", "same", "q", "delivered")]


def test_pages_make_up_the_whole(spark):
    frame = spark.range(25)
    pages = [rows(catalog.paged(frame, catalog.Page(n, 10), F.col("id").desc())) for n in (1, 2, 3)]
    assert sorted(sum(pages, [])) == rows(frame)
    assert catalog.totals(frame, 10).first() == (25, 3)
    for bad in ((0, 10), (1, 0), (1, 201), (True, 5)):
        with pytest.raises(ValueError):
            catalog.Page(*bad)


def test_facets_sum_to_the_total(spark):
    frame = spark.createDataFrame([("a",), ("",), (None,), ("a",)], "t string")
    assert rows(catalog.facet(frame, "t", ("a", "b"))) == [("__unknown__", 2), ("a", 2), ("b", 0)]


def test_latest_keeps_ties(spark):
    frame = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2), ("t", 1)], "g string, at int")
    assert rows(catalog.latest_per_group(frame, "g", "at")) == [("s", 2), ("s", 2), ("t", 1)]


def test_places(spark):
    frame = spark.createDataFrame([("吉林省", "长春市第一中学"), ("", "长春市与吉林市"), (None, None)], "region string, title string")
    got = places.matched(frame, (F.col("region"), F.col("title")), (("吉林省", "长春市"), ("吉林省", "吉林市")))
    assert [(r.province, r.city) for r in got.collect()] == [("吉林省", "长春市"), ("", ""), ("", "")]


def test_provenance(spark):
    registry = spark.createDataFrame([("gov.test", False, "official", "g"), ("lead.test", False, "commercial_lead", "l")], "domain string, exact_only boolean, role string, key string")
    page = '<a href="http://www.gov.test/n/1">原文</a><a href="/export?id=1">导出Word</a><a href="/go?url=https%3A%2F%2Fwww.gov.test%2Fa.pdf">x</a><a href="https://other.test/">y</a>'
    leads = spark.createDataFrame([("n", "https://lead.test/p", page)], "id string, url string, html string")
    found = provenance.candidates(leads, registry, "id", "url", "html")
    assert rows(found, "official_url", "kind") == [("https://www.gov.test/a.pdf", "official_attachment"), ("https://www.gov.test/n/1", "official_notice")]
    passed = spark.createDataFrame([("https://www.gov.test/a.pdf", True)], "official_url string, passed boolean")
    assert rows(provenance.resolved(found, passed)) == [("n", "https://www.gov.test/a.pdf", True)]
    group = '<table><tr><td>甲项目购置 第一中学</td><td><a href="/1">查看</a></td></tr><tr><td>乙项目购置 第一中学</td><td><a href="/2">查看</a></td></tr></table>'
    frame = spark.createDataFrame([("n", group)], "id string, html string")
    assert rows(provenance.row_links(frame, "id", "html", F.lit("乙项目购置"), F.lit("第一中学"), F.lit(""))) == [("n", "/2")]
    assert rows(provenance.row_links(frame, "id", "html", F.lit("项目"), F.lit(""), F.lit(""))) == []


def test_seeds(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿url,title,published_at\nhttps://a.test/1,,2026-01-05\nhttps://a.test/2,T,bad\n,x,2026-01-05\nhttps://a.test/3,U,2025-01-05\n", encoding="utf-8")
    notices, skipped = readers.seeds(spark, str(tmp_path / "s.csv"), "2026-01-01", "2026-12-31")
    (row,) = notices.collect()
    assert (row.title, row.source, row.published_at, len(row.external_id)) == ("https://a.test/1", "url_seed", "2026-01-05", 16)
    assert skipped.first()["skipped"] == 1


def test_feeds(spark):
    body = 'cb({"recordnum": 1, "datas": [{"title": "<b>T</b>", "timestamp": "2026年1月2日", "docpuburl": "https://a.test/1", "area": "吉林"}]});'
    assert rows(readers.jsonp_list(spark.createDataFrame([(body,), ("junk",)], "b string"), "b"), "url", "title", "published_at") == [("https://a.test/1", "T", "2026-01-02")]
    feed = json.dumps({"code": 200, "data": {"pages": 1, "records": [{"id": "1", "publishTime": "2026-03-01", "provinceText": "吉林", "cityText": "长春"}, {"id": "2", "publishTime": "2020-03-01"}]}})
    frame = spark.createDataFrame([(feed,)], "b string")
    assert rows(readers.json_feed(frame, "b", "2026-01-01", "2026-12-31", strict=False), "external_id", "region") == [("1", "吉林-长春")]
    with pytest.raises(Exception, match="outside the range"):
        readers.json_feed(frame, "b", "2026-01-01", "2026-12-31").collect()
    page = '<ul><li><a href="/1" title="甲">甲</a> 2025-01-01 发布 2026-01-02 采购人：第一中学 | x</li><li>none</li></ul>'
    assert rows(readers.result_list(spark.createDataFrame([(page,)], "h string"), "h"), "url", "title", "published_at", "buyer") == [("/1", "甲", "2026-01-02", "第一中学")]


def test_recall_is_cut_in_the_open(spark):
    got = readers.recall(spark.range(3), spark.range(10), "id", 4, "id")
    assert sorted((r.id, r.recall_origin, r.truncated) for r in got.collect())[2:5] == [(2, "baseline", True), (3, "broad", True), (4, "broad", True)]
    assert got.count() == 7


def test_file_texts(tmp_path, spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.bin", "x")
    assert readers.file_text("x.zip", out.getvalue()) == ("hello", True, "1 entries not read")
    assert readers.file_text("x.rar", b"x")[1] and readers.file_text("x.docx", b"junk")[1]
    (tmp_path / "a.html").write_text("<p>one</p><script>x</script>")
    (row,) = readers.files(spark, str(tmp_path)).collect()
    assert (row.text, row.needs_review) == ("one", False)


def test_sinks(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("=1", 2)], "a string, b int"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first() == ("'=1", "2")
    art = spark.createDataFrame([("k", "s", 1, "delivered", "rejected"), ("m", "s", 1, "x", "allowed")], "k string, sha256 string, size long, status string, gate_status string")
    files = spark.createDataFrame([("k", "t", 1)], "k string, sha256 string, length long")
    assert rows(sinks.violations(art, files, "k")) == [("k", "delivered_without_gate"), ("k", "hash_differs"), ("m", "missing_file")]


def test_conform(spark):
    got = model.conform(spark.createDataFrame([("a", "x", 5)], "source string, authority_rank string, extra int"), model.NOTICES, {"status": "discovered"})
    assert got.schema.names == model.NOTICES.names and got.first()["status"] == "discovered" and got.first()["authority_rank"] is None


def test_stream_merges_batches(spark, tmp_path):
    schema = "k int, v string, seq int"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for part in ([(1, "a", 1), (2, "b", 2), (1, "c", 3)], [(2, "d", 4), (3, "e", 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.merge_into(incremental.stream_of(spark, source, schema), table, str(tmp_path / "cp"), ["k"], ["seq"]).awaitTermination()
    assert rows(incremental.latest(spark, table), "k", "v") == [(1, "c"), (2, "d"), (3, "e")]


def test_visibility_and_spellings(spark):
    frame = spark.createDataFrame([("match",), ("suspect",), ("no_match",), (None,)], "v string")
    assert [catalog.filtered(frame, catalog.review_visible(c, F.col("v"))).count() for c in ("all", "keep", "suspect", "exact")] == [4, 3, 1, 1]
    groups = (("failed", ("失败", "fail")), ("downloaded", ("已下载", "done")))
    spelled = spark.createDataFrame([("Download FAILED",), ("已下载",), (None,)], "v string").select(catalog.spelled(F.col("v"), groups, "not_downloaded"))
    assert [r[0] for r in spelled.collect()] == ["failed", "downloaded", "not_downloaded"]


def test_live_states_lie_over_rows(spark):
    rows_, live = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string"), spark.createDataFrame([(2, "c")], "k int, s string")
    assert rows(catalog.overlaid(rows_, "k", live, "k", "s")) == [(1, "a"), (2, "c")]
    assert rows(catalog.selected(rows_, "k", live, "k")) == [(2, "b")]


def test_candidates_are_checked_again(spark):
    registry = spark.createDataFrame([("gov.test", False, "official", "g"), ("lead.test", False, "commercial_lead", "l")], "domain string, exact_only boolean, role string, key string")
    page = '<a href="http://www.gov.test:80/n/1#x">a</a><a href="https://WWW.gov.test/n/2?q">b</a><a href="http://other.test/n">c</a>'
    found = provenance.candidates(spark.createDataFrame([("n", "https://lead.test/p", page)], "id string, url string, html string"), registry, "id", "url", "html")
    assert rows(found, "official_url", "transport_upgraded", "original_url", "source_key") == [("https://www.gov.test/n/1", True, "http://www.gov.test:80/n/1", "g"), ("https://www.gov.test/n/2?q", False, "", "g")]
    assert rows(provenance.validated(found, registry), "official_url", "valid") == [("https://www.gov.test/n/1", True), ("https://www.gov.test/n/2?q", True)]
    for change in ({"official_url": "https://www.gov.test/n/3"}, {"source_key": "l"}, {"kind": "official_attachment"}, {"official_host": "gov.test"}, {"lead_url": "nonsense"}, {"original_url": "http://evil.test/"}):
        changed = found.withColumns({k: F.lit(v) for k, v in change.items()})
        assert [r["valid"] for r in provenance.validated(changed, registry).where("transport_upgraded").collect()] == [False], change
    assert provenance.validated(found, registry).columns == [*found.columns, "valid"]


def test_titles_with_a_purchaser_before_them(spark):
    assert provenance.title_keys_of("第一中学-采购意向—乙项目设备 购置") == ["第一中学采购意向乙项目设备购置", "乙项目设备购置"]
    assert provenance.title_keys_of("短") == [] and provenance.title_keys_of("第一中学采购-x") == ["第一中学采购x"]
    group = '<table><tr><td>甲项目设备购置 第一中学</td><td><a href="/1">查看</a></td></tr><tr><td>乙项目设备购置 第一中学</td><td><a href="/2?code=XM-7">查看</a></td></tr></table>'
    frame = spark.createDataFrame([("n", group)], "id string, html string")
    assert rows(provenance.row_links(frame, "id", "html", F.lit("第一中学-乙项目设备购置"), F.lit("第一&#x4E2D;学"), F.lit("xm 7"))) == [("n", "/2?code=XM-7")]
    assert rows(provenance.row_links(frame, "id", "html", F.lit("第一中学-设备购置"), F.lit(""), F.lit(""))) == []


def test_group_pages_are_read_once_by_one_function(spark, capsys):
    page = "<table><tr><td>第一中学乙项目购置</td><td><a href='/2'>看</a></td></tr><tr><td>丙</td><td><a href='/3'>看</a></td></tr></table>"
    given = [("g", page.encode("gb18030"), "text/html; charset=gb18030"), ("u", page.encode(), None), ("n", None, None)]
    frame = spark.createDataFrame(given, "id string, body binary, kind string")
    found = provenance.row_links(frame, "id", "body", F.lit("乙项目购置"), F.lit("第一中学"), F.lit(None).cast("string"), F.col("kind"))
    assert sorted(rows(found)) == [("g", "/2"), ("u", "/2")]
    found.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


SITE = "https://site.test"


def test_site_pages(spark):
    body = "某局防火墙采购公告正文，项目编号 X1，采购人： 第一中学</td><td>x 地址：某路。发布时间：2026-01-05。" + "说明文字" * 10
    pages = [
        ("/1", f"<h1>防火墙采购公告</h1><p>{body}</p>", None),
        ("/2", "<title>公告列表 - 某网</title><h1>采购公告列表</h1><p>" + "文字" * 30 + "</p>", None),
        ("/3", "<p>请输入验证码</p>" + "<p>文字文字文字文字文字文字文字文字文字文字文字</p>", None),
        ("/4", "<h1>网络安全验证系统采购公告</h1><p>项目名称：安全验证系统。发布日期 2026-02-03 " + "文字" * 20 + "</p>", None),
        ("/5", "<p>没有日期的一页" + "文字" * 20 + "</p>", "Tue, 03 Feb 2026 10:00:00 GMT"),
        ("/6", "<p>没有日期的一页" + "文字" * 20 + "</p>", None),
        ("/7", "<p>短</p>", None),
    ]
    frame = spark.createDataFrame([(SITE + a, b, c) for a, b, c in pages], "url string, html string, modified string")
    got = {r.url[len(SITE) :]: r for r in readers.site_pages(frame, "url", "html", last_modified="modified").collect()}
    assert {k: r.rejected for k, r in got.items()} == {"/1": "", "/2": "listing", "/3": "challenge", "/4": "", "/5": "", "/6": "no_date", "/7": "empty"}
    assert (got["/1"].title, got["/1"].published_at, got["/1"].notice_type, got["/1"].direct) == ("防火墙采购公告", "2026-01-05", "采购公告", True)
    assert got["/1"].buyer.startswith("第一中学") and "<" not in got["/1"].buyer and "地址" not in got["/1"].buyer
    assert (got["/5"].published_at, got["/5"].date_source, got["/4"].published_at) == ("2026-02-03", "last-modified", "2026-02-03")
    assert {r.rejected for r in readers.site_pages(frame.where("url like '%/1'"), "url", "html", terms=("云平台",)).collect()} == {"no_term"}


def test_detail_links(spark):
    page = '<title>采购公告</title><a href="/notice/1">甲</a><a href="/notice/1#x">甲again</a><a href="/a?id=12345">某某项目公告</a><a href="/b?id=12345">短</a><a href="/c">栏目四个字</a><a href="https://other.test/notice/2">外</a><a href="/notice/f.pdf">文件</a><a href="/detail/9">首页</a>'
    frame = spark.createDataFrame([(SITE + "/list", page)], "url string, html string")
    assert rows(readers.detail_links(frame, "url", "html"), "target", "label") == [(SITE + "/a?id=12345", "某某项目公告"), (SITE + "/notice/1", "甲")]


def test_lists_keep_the_first(spark):
    body = json.dumps({"recordnum": 2, "datas": [{"title": "A &amp; b", "timestamp": "2026-01-02", "url": "u"}, {"title": "later", "timestamp": "2026-01-03", "url": "u"}, {"title": "old", "timestamp": "2025-01-02", "url": "v"}]})
    frame = spark.createDataFrame([(body,)], "b string")
    assert rows(readers.jsonp_list(frame, "b", since="2026-01-01"), "url", "title") == [("u", "A & b")]
    with pytest.raises(Exception, match="not a list of records"):
        readers.jsonp_list(spark.createDataFrame([('{"datas": []}',)], "b string"), "b", strict=True).collect()
    feed = json.dumps({"data": {"records": [{"id": "1", "publishTime": "2026-03-01", "provinceText": "辽宁"}]}})
    with pytest.raises(Exception, match="another province"):
        readers.json_feed(spark.createDataFrame([(feed,)], "b string"), "b", "2026-01-01", "2026-12-31", province="吉林").collect()


def test_archives_and_pagers(spark, tmp_path):
    entries = spark.createDataFrame([("2026-01-05", "WAF 采购", ""), ("2026-02-05", "办公", "某waf公司"), ("2025-12-01", "x", "")], "published_at string, title string, buyer string")
    kept, edge = readers.within_archive(entries, "2026-01-01", "2026-12-31", ("Waf",))
    assert kept.count() == 2 and edge.first() == ("2025-12-01", True)
    page = "<ul><li><a href='/1'>a</a></li></ul> 共 1 条"
    got = readers.pager(spark.createDataFrame([(page,), (page.replace("共 1", "共 0"),), ("<p>",)], "h string"), "h").collect()
    assert [(r.total, r.n_pages, r.consistent) for r in got] == [(1, 1, True), (0, 0, False), (None, None, None)]
    entries.withColumn("day", F.to_date("published_at")).write.partitionBy("day").parquet(str(tmp_path / "t"))
    some = readers.on_days(spark, str(tmp_path / "t"), "2026-01-01", "2026-01-31")
    assert some.count() == 1 and "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()


def test_an_export_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_csv(spark.createDataFrame([("a", 1)], "a string, b int"), path, bom=True)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise("x").alias("a"))
    with pytest.raises(Exception, match="no"):
        sinks.write_csv(bad, path)
    part = next(x for x in (tmp_path / "out").glob("*.csv") if x.stat().st_size)
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa,b")
    sinks.write_csv(spark.createDataFrame([("b", 2)], "a string, b int"), path)
    assert spark.read.csv(path, header=True).first() == ("b", "2") and sorted(x.name for x in tmp_path.iterdir() if ".old" in x.name) == []


def test_promotion(spark):
    row = ("k", "s" * 64, 3, "allowed", "official", True, "https://a.test/f", "a b.pdf")
    arts = spark.createDataFrame([row, ("m", *row[1:3], "rejected", *row[4:]), ("n", *row[1:6], "http://a.test/f", row[7])], "k string, sha256 string, size long, gate_status string, source_role string, origin_verified boolean, source_url string, original_name string")
    files = spark.createDataFrame([(k, "s" * 64, 3) for k in "kmn"], "k string, sha256 string, length long")
    assert rows(sinks.promotable(arts, files, "k"), "k", "vault_path") == [("k", "ss/" + "s" * 64 + "/a b.pdf")]
    assert sinks.promotable(arts, files.withColumn("length", F.lit(4).cast("long")), "k").count() == 0


def test_choices_and_orders(spark):
    frame = spark.createDataFrame([("a", True, "review"), ("b", None, "review"), ("c", False, "review"), ("d", True, "filtered")], "k string, relevant boolean, status string")
    assert rows(frame.where(catalog.relevance("relevant_pending", F.col("relevant"), F.lit(False), F.col("status"))), "k") == [("a",), ("b",)]
    named = spark.createDataFrame([("2026-01-01", "张"), ("2026-01-01", "阿"), ("2026-01-02", "李"), (None, "b")], "d string, n string")
    assert [r.n for r in named.orderBy(*catalog.newest_first(F.col("d"), F.col("n"))).collect()] == ["李", "阿", "张", "b"]
    assert rows(catalog.counts_by_state(frame, "status")) == [("filtered", 1), ("review", 3)]
    assert [r[0] for r in spark.createDataFrame([("login_required",), ("x",), (None,)], "a string").select(catalog.access_label(F.col("a"))).collect()] == ["login required", "x", ""]


def test_canonical_cities(spark):
    frame = spark.createDataFrame([("长春", "吉林省"), ("延边", "吉林省"), ("吉林省", "吉林省"), ("别处", "吉林省"), (None, "吉林省")], "c string, p string")
    assert [r[0] for r in frame.select(places.canonical_city(F.col("c"), F.col("p"), ("长春市", "延边朝鲜族自治州"))).collect()] == ["长春市", "延边朝鲜族自治州", "", "别处", ""]
    assert frame.limit(1).select(places.province_alias(F.col("p"))).first()[0] == "吉林"


def test_streamed_windows_and_first_sightings(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    frame = spark.createDataFrame([("a", 1, "2026-01-01 10:05:00"), ("a", 1, "2026-01-01 10:06:00"), ("b", 2, "2026-01-01 11:30:00")], "g string, k int, t string").withColumn("t", F.to_timestamp("t"))
    frame.coalesce(1).write.parquet(source)
    rows_ = incremental.stream_of(spark, source, frame.schema)
    first = incremental.distinct_within(rows_, ["k"], "t", "1 hour")
    incremental.on_each(first, lambda batch, _: out.extend(r.k for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(out) == [1, 2]
    assert rows(incremental.hourly_counts(frame, "t", "g", "1 hour"), "g", "n") == [("a", 2), ("b", 1)]


def test_a_batch_writes_its_own_rows_and_like_generations_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "STAY", 2)
    schema, source, table = "k int, v string, first int, seq int", str(tmp_path / "in"), tmp_path / "table"

    def merge(part, keys=("k",), **how):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.merge_into(incremental.stream_of(spark, source, schema), str(table), str(tmp_path / "cp"), list(keys), ["seq"], keep=["first"], **how).awaitTermination()

    merge([(k, "a", 0, 0) for k in range(10_000)] + [(None, "n", 0, 0)])
    want = {k: ("a", 0) for k in range(10_000)} | {None: ("n", 0)}
    for n in range(1, 8):
        merge([(n, f"b{n}", n, n), (None, f"n{n}", n, n), (20_000 + n, "new", n, n)], fan=4)
        want |= {n: (f"b{n}", 0), None: (f"n{n}", 0), 20_000 + n: ("new", n)}
        own = table / f"generation={n:012d}-{n:012d}"
        assert spark.read.parquet(str(own)).count() == 3
    got = incremental.latest(spark, str(table))
    assert {r.k: (r.v, r.first) for r in got.collect()} == want and got.count() == len(want)
    counted, outlived = incremental._generations(spark, str(table))
    assert [g[:2] for g in counted] == [(0, 0), (1, 7)] and (1, 4) in [g[:2] for g in outlived]
    for n in range(8, 14):
        merge([(n, "c", n, n)], fan=4)
    assert not [g for g in incremental._generations(spark, str(table))[1] if g[1] <= 4]  # outlived long ago
    assert len(incremental._generations(spark, str(table))[0]) <= 4
    assert incremental.latest(spark, str(table)).count() == len(want)
    with pytest.raises(Exception, match="not"):
        merge([(1, "x", 1, 1)], keys=("k", "v"))
