"""Column functions on texts of our own."""

import io
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark import shipping
from quillspark.functions import dates, fields, gate, html, lexicon, money, text, urls
from quillspark.shipping import ROWS


def value(spark, column, **given):
    frame = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in given.items())) if given else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("said,unit,want", [("14.000000", "万元", 14_000_000), ("1,309,000.00", "元", 130_900_000), ("0.005", "", 1), ("x", "元", None), ("9" * 20, "元", None)])
def test_minor(spark, said, unit, want):
    assert value(spark, money.minor(F.col("n"), F.col("u")), n=said, u=unit) == want


def test_amount_takes_the_unit_from_the_label(spark):
    assert value(spark, money.after_label(F.col("t"), ("预算金额",)), t="预算金额（万元）：12.5") == 12_500_000
    assert value(spark, money.after_label(F.col("t"), ("最高限价",)), t="预算金额：1 最高限价(元) 30") == 3000


@pytest.mark.parametrize("cents,want", [(87_500_000, "875000.00"), (-5, "-0.05"), (None, ""), (0, "0.00")])
def test_yuan(spark, cents, want):
    assert spark.range(1).select(money.yuan(F.lit(cents).cast("long"))).first()[0] == want


@pytest.mark.parametrize("t,want", [("开标时间：2026年4月20日 9时5分", "2026-04-20 09:05"), ("开标时间 2026-2-30", ""), ("开标时间：2026/02/28", "2026-02-28"), ("", "")])
def test_labelled_date(spark, t, want):
    assert value(spark, dates.labelled_date(F.col("t"), ("开标时间",)), t=t) == want


def test_other_dates(spark):
    assert value(spark, dates.expected_month(F.col("t")), t="预计采购时间：2026-10") == "2026-10"
    assert value(spark, dates.expected_month(F.col("t")), t="预计采购时间：2026-13") == ""
    assert value(spark, dates.last_date(F.col("t")), t="2024-01-02 和 2025.3.4") == "2025-03-04"
    assert [tuple(map(str, r)) for r in dates.windows(spark, "2024-01-01", "2024-01-08", 5).collect()] == [("2024-01-01", "2024-01-05"), ("2024-01-06", "2024-01-08")]


@pytest.mark.parametrize("a,b", [("http://A.example.com:80//x//y/?b=2&a=1&utm_source=q#z", "https://a.example.com/x/y?a=1&b=2"), ("https://a.example.com", "http://a.example.com/"), ("https://a.example.com/?k=", "https://a.example.com?k=#f")])
def test_canonical_key(spark, a, b):
    assert value(spark, urls.canonical_key(F.col("u")), u=a) == value(spark, urls.canonical_key(F.col("u")), u=b)


@pytest.mark.parametrize("u,want", [("https://a.example.com/x", ""), ("https://u@a.example.com", "user_info"), ("ftp://a.example.com", "scheme"), ("https://a.example.com:8080", "port"), ("http://a.example.com:443", "scheme_port"), ("https://a b.example.com", "blank_or_control"), ("https://-a.example.com", "host"), ("", "empty"), ("https://localhost", "host")])
def test_policy(spark, u, want):
    assert value(spark, urls.policy_error(F.col("u")), u=u) == want


def test_longest_registered_suffix(spark):
    registry = spark.createDataFrame([("gov.test", False, "a"), ("x.gov.test", True, "b")], "domain string, exact_only boolean, key string")
    rows = spark.createDataFrame([("x.gov.test",), ("y.x.gov.test",), ("fakegov.test",), ("gov.test.evil.test",)], "h string")
    assert {r.h: r.key for r in urls.registered(rows, "h", registry, ("key",), "h").collect()} == {"x.gov.test": "b", "y.x.gov.test": "a", "fakegov.test": None, "gov.test.evil.test": None}


def test_text(spark):
    assert value(spark, text.clean_lines(F.col("t")), t=" a　 b \r\n\n\t c") == "a b\nc"
    assert value(spark, text.csv_safe(F.col("t")), t="=1+1") == "'=1+1"
    assert value(spark, text.head_and_tail(F.col("t"), 10, 3, 2), t="0123456789ab") == "012\n…\nab"
    assert value(spark, text.safe_component(F.col("t")), t="a%2Fb: c. ") == "a_b_ c"
    assert value(spark, text.safe_component(F.col("t")), t="con.txt") == "_con.txt"
    assert len(value(spark, text.safe_component(F.col("t")), t="x" * 300 + ".pdf")) == 120
    assert value(spark, text.semantic_match(F.col("a"), F.col("b"), True), a="abcdefghij", b="zzabcdefghiqq")
    assert not value(spark, text.semantic_match(F.col("a"), F.col("b")), a="abcdefghij", b="zzabcdefghiqq")


def test_rules(spark):
    verdict = lambda t: value(spark, lexicon.rule_decision(F.col("t")), t=t)
    assert verdict("采购防火墙")["relevant"] is True
    assert verdict("消防安全与防火墙")["relevant"] is None
    assert verdict("办公家具")["relevant"] is False
    assert value(spark, lexicon.industry(F.col("b"), F.col("t")), b="某某公司", t="某局关于第一中学的采购") == "教育"
    assert value(spark, lexicon.all_rules(F.col("t"), lexicon.CATEGORY_RULES, "其他网络安全"), t="WAF 与等保") == ["安全设备", "测评咨询"]


def test_recorded_answers(spark):
    good = '{"relevant": true, "confidence": 0.95, "evidence": ["采购防火墙"]}'
    assert value(spark, lexicon.parsed_verdict(F.col("r"), F.col("t")), r=good, t="本次采购防火墙一台")["relevant"] is True
    assert value(spark, lexicon.parsed_verdict(F.col("r"), F.col("t")), r=good, t="办公家具")["needs_review"] is True
    assert value(spark, lexicon.parsed_verdict(F.col("r"), F.col("t")), r="{", t="x")["relevant"] is None


NOTICE = """采购公告
项 目 编 号：
XM-2026-7
采购人信息
名 称：第一中学
地址：某路 1 号
预算金额（万元）：82.84
投标截止时间：2026年5月6日 9时30分
序号
供应商名称
中标金额
1
某某科技公司
824,600.00（元）"""


def test_extraction(spark):
    rows = spark.createDataFrame([("第一中学防火墙采购项目中标公告", "中标公告", NOTICE), (None, None, None)], "title string, notice_type string, text string")
    found, empty = fields.extracted(rows).collect()
    assert (found.project_code, found.budget_amount_minor, found.award_amount_minor) == ("XM-2026-7", 82_840_000, 82_460_000)
    assert (found.winning_vendor, found.bid_deadline, found.event_type, found.buyer_name) == ("某某科技公司", "2026-05-06 09:30", "中标公告", "第一中学")
    assert empty.event_type == "其他公告" and empty.project_code == "" and empty.award_amount_minor is None


def test_scope_of_group_notices():
    lines = "标题\n1\n甲单位\n网络设备更新项目\n10\n2\n乙单位\n办公家具购置项目\n20".split("\n")
    assert fields.scoped("办公家具购置项目采购意向", [*lines, "3", "丙"]) == ["2", "乙单位", "办公家具购置项目", "20"] or fields.scoped("办公家具购置项目采购意向", [*lines, "3", "丙"])[0] in "2 20"
    assert fields.scoped("没有的项目名称", lines) == lines


def test_pages(spark):
    page = '<title>T &amp; t</title><script>var x="</p>";</script><h1>Head</h1><p>Say <a href="a.pdf">附件</a><iframe src="/f"></iframe><ul><li>one <a href="/1">x</a></li></ul>'
    p = html.parse(page)
    assert p["title"] == "T & t" and "var x" not in p["text"] and {"url": "a.pdf", "label": "附件", "origin": "link"} in p["links"]
    assert p["rows"] == [{"text": "one x", "links": [{"url": "/1", "label": "x"}]}]
    assert html.parse(None)["text"] == ""
    assert html.resolved("https://a.test/x", "/go?url=https%3A%2F%2Fb.test%2Fy#f") == ["https://a.test/go?url=https%3A%2F%2Fb.test%2Fy", "https://b.test/y"]
    assert value(spark, html.attachment_error(F.col("u")), u="https://a.test/附件下载") == "placeholder"
    assert html.decoded("网络".encode("gb18030")) == "网络"


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def test_kinds():
    assert gate.kind_of(b"%PDF-1.7 x") == "pdf"
    assert gate.kind_of(archive(a_dot_txt="x")) == "zip"
    assert gate.kind_of(b"<!doctype html><p>") == "html"
    assert gate.kind_of(b' {"a":1}') == "json"
    assert gate.kind_of(b"") == "empty" and gate.kind_of(b"\x00\x01") == "unknown"


def test_gate(spark):
    page = ("<html><title>防火墙采购公告</title><body><p>第一中学防火墙采购公告，项目编号 XM-7。" + "正文内容" * 30 + "</p></body></html>").encode()
    schema = "id int, source_role string, origin string, final_url string, content_type string, body binary, analysis_body binary, expected_title string, expected_buyer string, expected_project_code string, document_kind string"
    ok = ("official", "https://a.gov.test/x.html", "https://a.gov.test/x.html", "text/html", page, None, "防火墙采购公告", "第一中学", "XM7", "html")
    rows = [(1, *ok), (2, *ok[:1], "http://a.gov.test/x.html", *ok[2:]), (3, *ok[:4], b"%PDF-1.4 ...", *ok[5:]), (4, *ok[:6], "别的标题完全不同啊啊", *ok[7:]), (5, *ok[:4], b"", *ok[5:]), (6, *ok[:4], page.replace("正文内容".encode(), "请完成安全验证".encode()), *ok[5:])]
    found = {r.id: (r.verdict, r.error_codes) for r in gate.verdicts(spark.createDataFrame(rows, schema), ("a.gov.test",)).collect()}
    assert found[1] == ("allow", [])
    assert "insecure_origin_transport" in found[2][1]
    assert "mime_magic_mismatch" in found[3][1]
    assert found[4][1] == ["expected_title_mismatch"]
    assert "empty_body" in found[5][1]
    assert "captcha_page" in found[6][1]


@pytest.mark.parametrize("a,b,same", [("https://a.test/?q=a%20b", "https://a.test/?q=a+b", True), ("https://a.test/?q=%E4%B8%AD", "https://a.test/?q=中", True), ("https://a.test/?b=1&a=%7E*", "https://a.test/?a=~%2A&b=1", True), ("https://a.test/?q=a", "https://a.test/?q=A", False), ("https://a.test/?q=%zz", "https://a.test/?q=%25zz", True), ("https://a.test/x//", "https://a.test/x", True)])
def test_one_spelling_of_an_address(spark, a, b, same):
    key = lambda u: value(spark, urls.canonical_key(F.col("u")), u=u)
    assert (key(a) == key(b)) is same


def test_spelled_as_the_form_encoder_does(spark):
    assert value(spark, urls.canonical_key(F.col("u")), u="http://A.test:8080/p?y=~*&x=%E4%B8%AD+%2F&utm_source=z&k=") == "a.test:8080/p?k=&x=%E4%B8%AD+%2F&y=~%2A"


@pytest.mark.parametrize("name,want", [("WWW.Example.com", "www.example.com"), ("bücher.example", "xn--bcher-kva.example"), ("中国.cn", "xn--fiqs8s.cn"), ("localhost", ""), ("a..b", ""), ("a.b.", ""), ("-a.b", ""), (None, "")])
def test_ascii_hosts(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(urls.ascii_host(F.col("n"))).first()[0] == want


def test_official_addresses(spark):
    address = lambda u: value(spark, urls.official_address(F.col("u"), urls.ascii_host(urls.host(F.col("u")))), u=u)
    assert address("https://A.gov.test:443?x=1#f") == "https://a.gov.test/?x=1"
    assert address("http://a.gov.test/") == "" and address("https://a.gov.test:8443/x") == "https://a.gov.test:8443/x"
    assert value(spark, urls.file_name(F.col("u")), u="https://a.test/d/a%20b.pdf?x") == "a b.pdf"
    assert value(spark, urls.file_name(F.col("u")), u="https://a.test") == "source.bin"


@pytest.mark.parametrize("url,label,want", [
    ("/a/b.PDF", "", True), ("/x", "招标文件.docx", True), ("/x", "文件下载", False), ("/download/", "文件下载", False), ("/download?id=7", "", True),
    ("/getfile?token=", "", False), ("/files/20260102", "", True), ("/files/abc123", "", True), ("/files/abc", "", False), ("/files?x=abcdef123456", "", True), ("/list?id=7", "", False), ("/attachment?a1b2c3", "", True),
])
def test_strong_attachments(spark, url, label, want):
    assert value(spark, html.strong_attachment(F.col("u"), F.col("l")), u=url, l=label) is want


def test_articles_and_scripts_of_pages():
    page = '<div>menu <a href="/m">m</a></div><div class="x ewb-article"><div>in</div> text <a onclick="go(\'a/b.pdf\')">f</a></div><div>foot</div>'
    inside = html.parse(page, "https://www.jl.gov.cn/ggzy/1.html")
    assert inside["text"].split() == ["in", "text", "f"] and [x["url"] for x in inside["links"]] == ["a/b.pdf"]
    assert "menu" in html.parse(page, "https://other.test/ggzy/1.html")["text"] and "menu" in html.parse(page.replace("ewb-", ""), "https://jl.gov.cn/ggzy/1")["text"]
    assert [x["url"] for x in html.parse('<button data-download-url="/f?id=1">x</button>')["links"]] == ["/f?id=1"]


SECTIONS = """一、项目信息
包号：2
采购人联系人：王某 地址：x
二、采购人信息
名 称：第一中学
地址：长春市某路 1 号
联系人：李某
联系电话：0431-81234567转12
三、采购代理机构信息
名 称：代理
联系人：赵某
电话：13912345678"""


def test_contacts_and_places(spark):
    rows = spark.createDataFrame([("t", "公告", SECTIONS, None, "2026-01-02"), ("t", "公告", SECTIONS.replace("采购人联系人：王某 地址：x\n", "客户联系电话：13800000000\n"), {"contact": "张某", "summary": "概况"}, ""), ("采购意向", "采购意向", "预算\n12.5\n2026 年 10 月", None, None)], "title string, notice_type string, text string, data map<string,string>, published_at string")
    a, b, c = fields.extracted(rows, data="data", cities=("长春市", "吉林市")).collect()
    assert (a.buyer_name, a.buyer_contact, a.buyer_phone, a.city, a.package_no, a.published_at) == ("第一中学", "王某", "0431-81234567转12", "长春市", "2", "2026-01-02")
    assert a.evidence["buyer_contact"].startswith("采购人联系人") and (a.winning_vendor_contact, a.winning_vendor_phone) == ("", "")
    assert (b.buyer_contact, b.buyer_phone, b.project_summary, b.buyer_address) == ("张某", "13800000000", "概况", "长春市某路 1 号")
    assert (c.event_type, c.expected_purchase_date, c.budget_amount_minor) == ("采购意向", "2026-10", 12_500_000)


def test_kinds_of_documents(spark):
    page = ("<html><title>公告</title><body><p>第一中学 公开招标 防火墙采购，项目编号 XM-7。" + "正文内容" * 30 + "</p></body></html>").encode()
    word = archive(word__document_dot_xml="<w>第一中学防火墙<b/>XM 7</w>", Content_Types="x", **{"[Content_Types]_dot_xml": "x"})
    answer = '{"title": "第一中学防火墙", "items": [{"code": "XM-7"}, null, 3]}'.encode()
    assert gate.json_text(answer.decode()) == "title 第一中学防火墙 items code XM-7 3" and gate.json_text("3") is None and gate.json_text("[" * 100_000) is None
    docx = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    schema = "id int, source_role string, origin string, final_url string, content_type string, body binary, analysis_body binary, expected_title string, expected_buyer string, expected_project_code string, document_kind string"
    item = lambda i, kind, body, rendered=None, wanted="", title="第一中学防火墙", url="https://a.gov.test/x": (i, "official", url, url, kind, body, rendered, title, "第一中学", "XM7", wanted)
    rows = [
        item(1, "text/html", page, wanted="招标公告", title=""), item(2, "text/html", page, wanted="合同公告", title=""), item(3, "text/html", page, wanted="附件", title=""), item(4, docx, word, wanted="官方附件"),
        item(5, docx, archive(word__document_dot_xml="<w>别的</w>", **{"[Content_Types]_dot_xml": "x"}), wanted="ＤＯＣＸ"), item(6, "application/json", answer, url="https://a.gov.test/x.json"), item(7, "application/json", b'{"a": ', url="https://a.gov.test/x.json"),
        item(8, "application/json", answer, rendered=answer.replace(b", null", b"")), item(9, "application/json", answer, rendered=b'{"other": "words entirely"}'), item(10, "text/html", page, rendered="<p>访问过于频繁</p>".encode(), title=""), item(11, "application/json", b'"text"', url="https://a.gov.test/x.json"),
    ]
    found = {r.id: r.error_codes for r in gate.verdicts(spark.createDataFrame(rows, schema), ("a.gov.test",)).collect()}
    assert found[1] == [] and found[2] == ["document_kind_mismatch"] and found[3] == ["document_kind_mismatch"] and found[4] == []
    assert found[5] == ["expected_title_mismatch", "expected_buyer_mismatch", "expected_project_code_mismatch"] and found[6] == []
    assert found[7] == ["malformed_json"] and found[8] == [] and found[9] == ["raw_render_mismatch"]
    assert "waf_block_page" in found[10] and found[11] == ["unsupported_media_type"]


def test_answers_keep_to_the_lists(spark):
    answer = '{"relevant": true, "confidence": 7, "evidence": [" 采购防火墙 ", "x", "网络安全"], "industry": "教育", "security_categories": ["安全设备", "nonsense"], "reason": "r"}'
    v = lambda raw, **more: value(spark, lexicon.parsed_verdict(F.col("r"), F.col("t"), title=F.lit(more.get("title", "")), buyer=F.lit(more.get("buyer", ""))), r=raw, t="本次采购防火墙一台")
    got = v(answer)
    assert (got["relevant"], got["confidence"], got["evidence"], got["industry"], got["categories"], got["reason"]) == (True, 1.0, ["采购防火墙"], "教育", ["安全设备"], "r")
    assert v(answer, buyer="某某医院")["industry"] == "医疗卫生"
    other = v(answer.replace("教育", "太空").replace('"安全设备", ', ""))
    assert (other["industry"], other["categories"]) == ("其他行业", ["安全设备"])


def test_two_answers(spark):
    yes = '{"relevant": true, "confidence": 0.95, "evidence": ["采购防火墙"]}'
    no = '{"relevant": false, "confidence": 0.9, "evidence": []}'
    pair = lambda a, b: value(spark, lexicon.agreed(lexicon.parsed_verdict(F.col("a"), F.col("t")), lexicon.parsed_verdict(F.col("b"), F.col("t"))), a=a, b=b, t="采购防火墙")
    assert (pair(yes, yes.replace("0.95", "0.9"))["relevant"], pair(yes, yes.replace("0.95", "0.9"))["confidence"]) == (True, 0.9)
    assert pair(yes, no)["needs_review"] is True and pair(yes, no)["relevant"] is None
    assert pair(no, no)["relevant"] is False


def test_focused_text():
    text_ = "头" * 60_000 + "防火墙" + "尾" * 60_000
    got = lexicon.focused(text_)
    assert got.startswith("头" * 10_000) and "防火墙" in got and len(got) < 13_000 and lexicon.focused("短") == "短"
    assert len(lexicon.focused("网络" * 60_000)) <= 50_000


def test_found_terms_by_alternation(spark):
    t = F.col("t")
    assert value(spark, lexicon.has_any(t, ("a.b", "WAF")), t="use waf") and not value(spark, lexicon.has_any(t, ("a.b",)), t="aXb") and not value(spark, lexicon.has_any(t, ()), t="x")
    assert value(spark, lexicon.found_terms(t, ("WAF", "ids")), t="IDS and Waf") == ["WAF", "ids"]


@pytest.mark.parametrize("function,given", [(html.parsed, ("<p>a</p>",)), (html.parsed_at, ("<p>a</p>", "https://a.example/")), (gate.read, (b"<p>a</p>", "", None, "", "", "", "")), (fields.table_values, ("a", "b")), (html.linked, ("https://a.example/", "<a href='/b?url=https%3A%2F%2Fc.example'>b</a>"))])
def test_long_batches_are_taken_in_parts(function, given):
    batch = tuple(pd.Series([x] * (2 * ROWS + 88), dtype=object) for x in given)
    found = list(function.__wrapped__(iter([batch if len(given) > 1 else batch[0]])))
    assert [len(x) for x in found] == [ROWS, ROWS, 88]
    assert all(str(x.iloc[0]) == str(found[0].iloc[0]) for x in found)


@pytest.mark.parametrize("function,given", [(html.parsed, ("<title>a</title><li><a href='/b'>b</a>",)), (html.parsed_at, ("<p>a</p>", "https://a.example/")), (gate.read, (b"<p>a</p>", "", None, "", "", "", "")), (html.linked, ("https://a.example/", "<a href='/b'>b</a>"))])
def test_of_a_batch_only_a_part_becomes_objects(spark, monkeypatch, function, given):
    monkeypatch.setattr(shipping.F, "arrow_udf", lambda run, returns: lambda *columns: run)
    kinds = [pa.binary() if isinstance(x, bytes) or x is None else pa.string() for x in given]
    batch = tuple(pa.array([x] * (2 * ROWS + 88), type=kind) for x, kind in zip(given, kinds, strict=True))
    found = list(function("x")(iter([batch if len(given) > 1 else batch[0]] * 2)))
    assert [len(x) for x in found] == [ROWS, ROWS, 88] * 2 and all(isinstance(x, pa.Array) for x in found)
    asked = [pd.Series([x], dtype=object) for x in given]
    plain = next(function.__wrapped__(iter([tuple(asked) if len(given) > 1 else asked[0]])))
    assert found[0][0].as_py() == (plain.iloc[0] if isinstance(plain, pd.Series) else plain.to_dict("records")[0])


def test_functions_on_whole_pages_get_parts(spark):
    @shipping.vectorised_in_parts("long")
    def lengths(batches):
        for x in batches:
            yield pd.Series([len(x)] * len(x))

    found = spark.range(2 * ROWS + 88).coalesce(1).select(lengths("id").alias("n")).groupBy("n").count().collect()
    assert sorted((r["n"], r["count"]) for r in found) == [(88, 88), (ROWS, 2 * ROWS)]


def test_a_column_of_many_pages_keeps_its_rows(spark):
    pages = spark.range(3 * ROWS).coalesce(1).select("id", F.concat(F.lit("<p>"), "id", F.lit("</p>")).alias("page"))
    assert pages.where(html.parsed(F.col("page"))["text"] != F.col("id").cast("string")).count() == 0


def test_orders_are_dealt_out_before_the_extraction(spark, sf, capsys):
    entry.queries()["field_extraction"](spark, sf).explain("simple")
    plan = capsys.readouterr().out
    assert plan.index("table_values") < plan.index("Exchange hashpartitioning(o_orderkey") < plan.index("FileScan")


def test_keys_of_lines_are_remembered_and_numbers_of_rows_are_decimals():
    assert fields._key("中标 金额（元）A1") == fields._key("中标 金额（元）A1") == "中标金额元a1" and fields._short_key.cache_info().hits
    assert [fields._is_number(x) for x in ("1", "1234", "12345", "", "1a", "²", "٣")] == [True, True, False, False, False, False, True]
