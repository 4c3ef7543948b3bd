"""Operators that work row by row, and the models."""

import gzip
import hashlib
import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillspark.llm import bytebpe, langid, linerules, mixing, registry, urltrees, warc, weaklabel

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(bytebpe.load_ranks(PATH), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(codec):
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(1)
    parts = ["a", "b", " ", "\n", "\x1c", "\x85", "\xa0", "\u3000", "1", "é", "漢", "😀", "ing", "the", "  ", "!", "\u180e", "\u200b", "²", "Ⅷ", "\t", "'s", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["a" * 20_000 + " " * 3000 + "=-" * 3000]
    for t in texts:
        ids = codec.encode(t)
        assert ids == other.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_tables(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (None, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("ids", F.lit(2))
    ids = bytebpe.encode(docs, PATH, public_tokenizers.PATTERN)
    back = bytebpe.decode(ids, PATH, public_tokenizers.PATTERN)
    assert sorted((r[0] or 0, bytes(r[1]).decode()) for r in back.collect()) == sorted((d or 0, t or "") for d, t in rows)
    found = {r["doc_id"]: r for r in bytebpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert found[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == found[3]["decoded_sha256"] and found[2]["n_tokens"] == 0
    assert bytebpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    gru = langid.Gru(rng.normal(size=(6, 256)).astype(np.float32), rng.normal(size=(6, 2)).astype(np.float32))
    x = rng.integers(0, 256, (7, 3)).astype(np.uint8)
    way = rng.normal(size=(7, 2, 3)).astype(np.float32)
    kept: list = []
    langid._states(gru, x, range(7), kept)
    grads = langid._grads(gru, x, kept, way)
    for name, at in (("byte", (4, int(x[3, 1]))), ("state", (1, 0)), ("state", (5, 1)), ("byte", (0, int(x[0, 0])))):
        diff = []
        for step in (1e-2, -1e-2):
            moved = gru._replace(**{name: getattr(gru, name).copy()})
            getattr(moved, name)[at] += step
            diff.append(float((langid._states(moved, x, range(7)) * way).sum()))
        assert abs((diff[0] - diff[1]) / 2e-2 - getattr(grads, name)[at]) < 5e-2


def test_language_of_documents_not_learned_from(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in registry.op2_language(spark, "/root/testdata/sf0.01").collect()}
    true = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    held = [k for k, r in found.items() if r["held_out"]]
    assert np.mean([found[k]["lang_pred"] == true[k] for k in held]) > 0.97


def test_trees_know_more_than_the_majority_of_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = urltrees.placed(pages, registry.URL_RULES).where("listed is not null").dropDuplicates(["url"])
    kept = F.pmod(F.xxhash64(F.lit("kept"), "url"), F.lit(3)) == 0
    judge = urltrees.learned(rows.withColumn("listed", F.when(~kept, F.col("listed"))))
    got = rows.where(kept).select("url", "host", "path", "suffix", "listed").collect()
    x = np.array([[*urltrees.lexical(r["url"], r["host"], r["path"]), judge.suffixes.rate[0, r["suffix"]], judge.suffixes.count[r["suffix"]]] for r in got])
    score, true = judge.forest.probability(x), np.array([r["listed"] == "block" for r in got])
    better = np.subtract.outer(score[true], score[~true])
    assert ((score >= urltrees.LEAST) == true).mean() > max(true.mean(), 1 - true.mean()) + 0.1
    assert (better > 0).mean() + (better == 0).mean() / 2 > 0.85


FOREIGN = {
    "zh": "本项目采用公开招标方式采购,欢迎符合条件的供应商参加投标。采购人为第一中学,预算金额为九十万元。",
    "ru": "Съешь же ещё этих мягких французских булок, да выпей чаю. Россия является крупнейшей страной мира по территории.",
    "ar": "اللغة العربية هي أكثر اللغات السامية تحدثا وإحدى أكثر اللغات انتشارا في العالم يتحدثها أكثر من مليون",
    "ja": "日本国民は、正当に選挙された国会における代表者を通じて行動し、われらとわれらの子孫のために、",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "code": "for (int i = 0; i < n; i++) { if (a[i] > b[i]) { swap(a[i], b[i]); } } return std::max(x, y);",
    "json": '{"a": [1, 2, {"b": null}], "c_d": {"e": [[0, 1], [2, 3]], "f": "x"}, "g": [{"h": 1}, {"h": 2}]}',
}


def test_texts_in_no_learned_language_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    odd = spark.createDataFrame([(-1 - n, x * 3) for n, x in enumerate(FOREIGN.values())], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd)
    kept = {r["doc_id"] for r in langid.spoken(rows, model).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if r["text"] and langid.LETTER.search(r["text"])}
    with pytest.raises(ValueError):
        langid.identify(docs, model, keep=("lang", "score"))


def test_windows_in_no_language():
    scripts = langid.unused_scripts(["the cat", "Кошка и собака"])
    assert (0x61, 0x7A) not in scripts and (0x410, 0x44F) not in scripts and (0x4E00, 0x9FA5) in scripts
    rng = np.random.default_rng(1)
    true = np.frombuffer(b"the cat sat on the mat and so on, and so on and so on for long.." * 2, np.uint8)[:64]
    for _ in range(200):
        assert 0 < len(langid.unlike(rng, true, scripts, 64)) <= 64


def test_language_of_odd_texts(spark):
    text = "the cat and the dog were there. " * 30
    rows = [(i, text if i % 2 else "le chat et le chien sont ici. " * 30, "en" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, text * 500), (4, text), (None, "the")], "doc_id long, text string").withColumn("lid_text", F.lit("x")).withColumn("score", F.lit(1))
    got = sorted(((r["doc_id"] or 0), r["lang_pred"]) for r in langid.identify(odd, model).collect())
    assert got[1:4] == [(1, "und"), (2, "und"), (3, "und")] and got[4:] == [(4, "en"), (4, "en")]
    kept = langid.spoken(odd, model)
    assert kept.columns == odd.columns and kept.count() == 3
    assert langid.fit(docs.limit(0)) is None and {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    a, b = (langid.predict(model, [x], window=64) for x in (text, text))
    assert a == b


def test_windows_count_every_byte_once():
    for n in (1, 63, 64, 65, 200):
        windows, counts = langid._windows(bytes(range(1, 201))[:n], 64)
        assert counts.sum() == n and windows.shape[1] == 64
        tail = windows[-1][: counts[-1]] if n < 64 else windows[-1][64 - counts[-1] :]
        assert tail.tolist() == list(range(1, 201))[:n][-int(counts[-1]) :]


def water(sizes, weights):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        left, weight = total - sum(3 * sizes[i] for i in range(len(sizes)) if i not in open_), sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / weight > 3 * sizes[i]} if weight else set()
        if not full:
            for i in range(len(sizes)):
                target[i] = left * weights[i] / weight if i in open_ else 3.0 * sizes[i]
            return target
        open_ -= full


def test_mixing(spark):
    r = random.Random(4)
    share = {"a": 500, "b": 4, "c": 60, "d": 2, "\U0001f600": 30, "\uffff": 9, None: 40, "zero": 3}
    rows = [(len(share) * i + k, " ".join(["w"] * (0 if s == "zero" else r.randint(0, 60))), s) for k, (s, n) in enumerate(share.items()) for i in range(n)]
    rows += [rows[0], (None, "x y", "a"), (None, "x y", "a"), (10**6, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(1)).withColumn("content", F.lit("z"))
    labels = spark.createDataFrame([(0, 1), (0, 0), (8, 0), (None, 1)], "doc_id long, quality int")
    got = mixing.plan(docs, labels).collect()
    assert len(got) == len(rows)
    names = sorted((s for s in share if s is not None), key=lambda s: s.encode()) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    for n, size, want in zip(names, sizes, water(sizes, [i % 3 + 1 for i in range(len(names))]), strict=True):
        own = [x for x in got if x["source"] == n]
        assert {x["source_size"] for x in own} == {size} and all(abs(x["target"] - want) < 1e-6 for x in own)
        assert abs(sum(x["taken"] for x in own) - want) <= 31
    assert all(x["taken"] <= 3 * x["size"] for x in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.plan(docs.repartition(7), labels).collect()), key=repr)
    mix = mixing.mixed(docs, labels)
    assert mix.columns == docs.columns and mix.count() == sum(x["copies"] for x in got)
    assert mixing.mixed(docs.limit(0), labels).count() == 0
    nodes = mix._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def test_better_documents_come_first(spark):
    rows = [(i, "w " * 10, "a" if i < 1000 else "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    taken = mixing.plan(docs, labels).where("source = 'a' and copies > 0").selectExpr("avg(doc_id % 2) as good").first()["good"]
    assert taken > 0.6


PAGE = "<html><head><title>A &amp; b</title><style>x{}</style></head><body><!-- no --><script>var t='</p>';</script><p>One  two<br>three</p><a href='/x?a=1&amp;b=2'>four</a></body></html>"


def test_warc_records(spark):
    meta, text = warc.derive_one("<urn:uuid:1>", "https://a.test/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: x", PAGE.encode(), None, "sha1:BLOCK")
    assert text.block == "One two\nthree\nfour" and text.refers_to == meta.refers_to == "<urn:uuid:1>"
    assert text.concurrent_to is None and b"Concurrent" not in warc.serialised(text) and meta.concurrent_to == "<urn:uuid:1>" and meta.source_block_digest == "sha1:BLOCK"
    about = json.loads(meta.block)
    assert about["title"] == "A & b" and about["links"] == ["/x?a=1&b=2"] and about["headers"] == [["Server", "x"]]
    assert about["payload-digest"] == text.source_payload_digest == warc.digest(PAGE.encode())
    for data in (warc.serialised(meta) + warc.serialised(text), gzip.compress(warc.serialised(meta)) + gzip.compress(warc.serialised(text))):
        found = list(warc.records(data))
        assert [h["warc-type"] for h, _ in found] == ["metadata", "conversion"] and found[1][1].decode() == text.block
        assert warc.digest(found[0][1]) == found[0][0]["warc-block-digest"]
    assert list(warc.records(warc.serialised(text)[:-9])) == [] and list(warc.records(b"")) == []


def test_warc_files_and_tables(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\nWARC-Target-URI: http://a.test\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(head + block + b"\r\n\r\n"))
    source = warc.read_responses(spark, str(tmp_path))
    assert source.first()["http_headers"] == "HTTP/1.1 200 OK\r\nA: b"
    assert {r["record_type"]: r["block"] for r in warc.derive(source).collect()}["conversion"] == "x"
    rows = [(1, "http://a", PAGE), (2, None, None), (None, "", ""), (1, "http://a", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1))
    got = warc.derive(warc.responses(pages), "page_id").collect()
    assert len(got) == 8 and {r["refers_to"] for r in got if r["page_id"] == 1}.__len__() == 1
    assert all(len(r["record_id"]) == 47 and r["content_length"] == len(r["block"].encode()) for r in got)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_line_rules():
    good = "This is a plain sentence of nine words here. " * 8
    assert linerules.judge(good + "\n").base_failed  # it repeats itself
    prose = " ".join(f"word{i}" for i in range(80)) + "."
    v = linerules.judge(prose + "\nHome | About | News | Contact\nAll rights reserved.\nno end")
    assert (v.kept, v.n_navigation, v.n_boilerplate, v.n_punctuation) == (True, 1, 1, 1) and v.cleaned == prose
    bars = " | ".join(f"word{i}" for i in range(80)) + "."
    assert not linerules.judge(bars).kept and linerules.judge(bars).lost_chars == linerules.judge(bars).word_chars
    assert linerules.judge("a\nb\na\n \n \n").n_dup_lines == 1
    words = "a b c d a b c x a b c".encode().split()
    assert linerules.repeated_words(words) == 9
    assert linerules.judge(None) == linerules.judge("") and linerules.judge("é\x1cé x").word_chars == 4
    assert linerules.judge("漢字 ab#$").n_symbols == 2


def test_line_rules_table(spark):
    docs = spark.createDataFrame([(1, None), (2, "x " * 200_000), (None, "a")], "doc_id long, text string").withColumn("kept", F.lit(1))
    got = {r["doc_id"]: r for r in linerules.clean(docs).collect()}
    assert got[2]["n_words"] == 200_000 == got[2]["n_repeat_words"] and not got[1]["kept"]
    assert linerules.clean(docs.limit(0)).count() == 0


def test_weak_labels_recover_accuracies():
    rng = np.random.default_rng(1)
    true = rng.random(4000) < 0.7
    acc = np.array([0.9, 0.85, 0.7, 0.8, 0.95, 0.75, 0.9, 0.6])
    ballots = np.where(rng.random((4000, 8)) < acc, true[:, None], ~true[:, None]).astype(int)
    ballots[rng.random(ballots.shape) < 0.3] = weaklabel.SILENT
    rows, counts = np.unique(ballots, axis=0, return_counts=True)
    model = weaklabel.estimate(rows, counts.astype(float))
    assert abs(model.share - 0.7) < 0.03
    assert ((model.posterior(ballots) > 0.5) == true).mean() > 0.95


def test_weak_labels_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.op6_weak_labels(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1]
    assert np.mean(clean) > 0.99 and np.mean([r["kept"] for r in got if r["quality"] == 0]) < 0.2
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "One plain sentence."), (None, "x " * 100_000)], "doc_id long, text string").withColumn("score", F.lit(1))
    fitted = weaklabel.fit(docs)
    assert {r["doc_id"]: r["kept"] for r in weaklabel.scored(docs, *fitted).collect()}[1] is False
    assert weaklabel.scored(docs.limit(0), *weaklabel.fit(docs.limit(0))).count() == 0


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def rule_by_force(host, path):
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits, key=len, default=None)


def test_url_rules(spark):
    urls = ["http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "http://x.org", "http://x.org/", "ftp://b.com/fr/1", "http://fakecom/fr/", "c.com/de/", None, "", "x://y.com/de/?://z.org/", "http://ÀB.com/de/", "http://com/de/q", "http://a.org?x/", "://org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("key", F.lit("k"))
    for r in urltrees.judged(pages, RULES).collect():
        u = urls[r["page_id"]] or ""
        rest = u.partition("://")[2] if "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule_by_force(host, path))
        assert r["verdict"] == RULES[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")
    assert urltrees.judged(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in urltrees.judged(pages, {}).collect()} == {"allow"}


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = urltrees.boost(x[:2000], y[:2000])
    assert ((forest.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_trees_stop_where_they_no_longer_help():
    rng = np.random.default_rng(1)
    x, noise = rng.normal(size=(1200, 6)), (rng.random(1200) < 0.3).astype(float)
    watched = np.arange(1200) % 5 == 4
    assert len(urltrees.boost(x, noise, watched=watched).trees) < 15 < len(urltrees.boost(x, (x[:, 0] > 0).astype(float), watched=watched).trees)
    assert len(urltrees.boost(x, noise).trees) == urltrees.TREES == len(urltrees.boost(x, noise, watched=np.ones(1200, bool)).trees)


def test_an_unclosed_head_ends_where_the_body_begins():
    pages = {"<html><head><title>t</title><body><p>Hello</p>": "Hello", "<head><meta x><title>t</title>Hello <b>x</b>": "Hello x", "a<noscript>b<p>c": "ab\nc", "a<template>b": "ab", "a<script>b<p>c": "a", "<head><title>t</title></head>a<noscript>b</noscript>c": "a c"}
    assert {p: warc.plain_text(p) for p in pages} == pages


def test_good_records_after_a_broken_one_are_read():
    meta, text = map(warc.serialised, warc.derive_one("<urn:uuid:1>", payload=PAGE.encode()))
    for broken in (meta.replace(b"Content-Length: ", b"Content-Length: x"), meta.replace(b"Content-Length: ", b"Content-Length: 99999")):
        skipped = []
        found = list(warc.records(meta + broken + text, skipped.append))
        assert [h["warc-type"] for h, _ in found] == ["metadata", "conversion"] and skipped == [len(broken)]


def record(block, uri="http://a.test", **more):
    more = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nWARC-Target-URI: {uri}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_payloads_are_bytes_in_their_charset(spark, tmp_path):
    """Source digests, header and meta charsets, chunks and gzip; a broken record between good ones; both ways of reading."""
    latin = "caf\u00e9 <p>na\u00efve".encode("latin-1")
    ok = b"HTTP/1.1 200 OK\r\n"
    zipped = gzip.compress("<p>\u6f22\u5b57".encode())
    rows = {
        "a": record(ok + b"Content-Type: text/html; charset=ISO-8859-1\r\n\r\n" + latin, "a", WARC_Payload_Digest=warc.digest(latin), WARC_Block_Digest="sha1:X"),
        "b": record(ok + b"\r\n<meta charset='windows-1251'>" + "\u0434\u0430".encode("cp1251"), "b", WARC_Payload_Digest="sha1:WRONG"),
        "broken": record(ok + b"\r\nx").replace(b"Content-Length: ", b"Content-Length: 99999999"),
        "c": record(ok + b"Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped), "c"),
        "d": record(ok + b"\r\n\xef\xbb\xbfz\r\n\r\nzz" + b"y" * 300_000, "d"),
        "e": record(ok + b"Content-Type: text/html; charset=nonsense\r\n\r\n\xff", "e"),
    }
    (tmp_path / "x.warc").write_bytes(b"".join(rows.values()))
    (tmp_path / "y.warc.gz").write_bytes(b"".join(map(gzip.compress, rows.values())))
    want = {"a": "caf\u00e9\nna\u00efve", "b": "\u0434\u0430", "c": "\u6f22\u5b57", "d": "z\nzz" + "y" * 300_000, "e": "\ufffd"}
    for whole in (False, True):
        skipped = spark.sparkContext.accumulator(0)
        source = warc.read_responses(spark, str(tmp_path), skipped, whole_files=whole)
        got = warc.derive(source).collect()
        assert skipped.value == 2 and len(got) == 20
        assert {(r["target_uri"], r["block"]) for r in got if r["record_type"] == "conversion"} == set(want.items())
        about = {r["target_uri"]: json.loads(r["block"]) for r in got if r["record_type"] == "metadata"}
        assert (about["a"]["payload-agrees"], about["b"]["payload-agrees"], about["c"]["payload-agrees"]) == (True, False, True)
        assert {r["source_payload_digest"] for r in got if r["target_uri"] == "a"} == {warc.digest(latin)} and {r["source_block_digest"] for r in got if r["target_uri"] == "a"} == {"sha1:X"}


def read_plainly(data):
    """Another reader: line by line through the headers, then so many bytes."""
    file, out = io.BytesIO(data), []
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = file.read(int(headers["content-length"]))
        if headers["warc-type"] == "response":
            out.append((headers["warc-target-uri"], block.partition(b"\r\n\r\n")[2]))
    return sorted(out)


def quoting(r, n):
    """Responses whose pages quote records, or parts of them, at any place."""
    ok, forged = b"HTTP/1.1 200 OK\r\n\r\n", record(b"HTTP/1.1 200 OK\r\n\r\nforged text", "http://victim.test")
    parts = [b"page", b"\r\n\r\n", b"\r\n\r\nWARC/", b"WARC/1.1\r\n", forged, b"\r\n\r\n" + forged, b"Content-Length: 5", b"x" * 700]
    out = [record(b"\r\n\r\n" + forged if n == 0 else ok + b"".join(r.choice(parts) for _ in range(r.randint(0, 6))), f"http://{n}.test")]
    return out + ([record(b"", f"http://{n}.empty")] if n % 5 == 0 else [])


@pytest.mark.parametrize("whole", [False, True])
def test_pages_that_quote_records_forge_none(spark, tmp_path, whole):
    r = random.Random(7)
    good = record(b"HTTP/1.1 200 OK\r\n\r\n<pre>\r\n\r\n" + record(b"HTTP/1.1 200 OK\r\n\r\nforged text", "http://victim.test") + b"</pre>", "http://a.test")
    files = {"a.warc": good + record(b"HTTP/1.1 200 OK\r\n\r\nb", "http://b.test")}
    for k in range(4):
        files[f"{k}.warc"] = b"".join(x for n in range(25) for x in quoting(r, n))
    want = []
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data))
        want += read_plainly(data) * 2
    skipped = spark.sparkContext.accumulator(0)
    got = sorted((x["target_uri"], bytes(x["payload"])) for x in warc.read_responses(spark, str(tmp_path), skipped, whole_files=whole).collect())
    assert got == sorted(want) and skipped.value == 0
    assert "http://victim.test" not in {u for u, _ in got}


def test_records_do_not_depend_on_how_a_file_is_read():
    r = random.Random(8)
    for _ in range(60):
        parts = [x for n in range(6) for x in quoting(r, n)]
        if r.random() < 0.5:
            parts.insert(r.randrange(len(parts)), r.choice([b"junk\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", parts[0][:50] + b"\r\n\r\n", b"\r\n"]))
        data = b"".join(parts)
        want = list(warc.records(data))
        for form in (data, gzip.compress(data), b"".join(map(gzip.compress, parts))):
            for size in (1, 7, 100, 1 << 20):
                assert list(warc.streamed(io.BytesIO(form), size=size)) == want


def test_codings_and_their_limit(monkeypatch):
    text = b"<p>" + b"word " * 100
    zipped = gzip.compress(text)
    chunks = b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)
    assert warc.decoded(chunks, "HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, chunked") == text.decode()
    monkeypatch.setattr(warc, "MOST_UNPACKED", 50)
    assert warc.decoded(zipped, "HTTP/1.1 200 OK\r\nContent-Encoding: gzip") == text.decode()[:50]


def test_samples(spark):
    """Equal rows are one, each value has its share, and what one can't fill goes to the others."""
    from quillspark.llm.common import sampled

    rows = spark.range(60_000).selectExpr("case when id < 50000 then 7 else xxhash64(id) end as h", "case when id < 50000 then 'same' when id % 100 = 0 then null else 'many' end as k")
    got = [r["k"] for r in sampled(rows, "h", 3000, by="k").collect()]
    assert got.count("same") == 1 and got.count(None) == 100 and 2500 < got.count("many") <= 3000
    got = [r["h"] for r in sampled(rows, "h", 500).collect()]
    assert len(got) == 500 == len(set(got)) and sampled(rows.limit(0), "h", 5).count() == 0


def logistic(x):
    return 1 / (1 + np.exp(-x))


def test_language_network_against_a_plain_one():
    """Position by position, with one state vector at a time."""
    rng = np.random.default_rng(5)
    gru = lambda: langid.Gru(rng.normal(size=(9, 256)).astype(np.float32), rng.normal(size=(9, 3)).astype(np.float32))
    model = langid.Model(("a", "b"), gru(), gru(), rng.normal(size=(3, 6)).astype(np.float32), rng.normal(size=(3, 1)).astype(np.float32))
    texts = ["x", "na\u00efve caf\u00e9", "abc def " * 20, None, "12"]
    got = langid.predict(model, texts, window=16)
    for text, (lang, score, none) in zip(texts, got, strict=True):
        if text is None or text == "12":
            assert (lang, score, none) == ("und", 0.0, 1.0)
            continue
        data = text.encode()
        starts = list(range(0, len(data) - len(data) % 16, 16)) + ([len(data) - 16] if len(data) > 16 and len(data) % 16 else [0] if len(data) < 16 else [])
        total, seen = np.zeros(3), set()
        for at in starts:
            window = data[at : at + 16].ljust(16, b"\0") if at >= 0 else data.ljust(16, b"\0")
            states = []
            for g, order in ((model.forward, range(16)), (model.backward, range(15, -1, -1))):
                h, out = np.zeros(3), {}
                for t in order:
                    i, s = g.byte[:, window[t]], g.state @ h
                    z, r = logistic(i[:3] + s[:3]), logistic(i[3:6] + s[3:6])
                    h = (1 - z) * np.tanh(i[6:] + r * s[6:]) + z * h
                    out[t] = h
                states.append(out)
            for t in range(16):
                if at + t < len(data) and at + t not in seen:
                    seen.add(at + t)
                    e = np.exp(model.out @ np.concatenate([states[0][t], states[1][t]]) + model.bias[:, 0])
                    total += e / e.sum()
        assert len(seen) == len(data)
        assert lang == "ab"[total.argmax()] and abs(score - total.max() / len(data)) < 1e-4


def test_what_the_network_rejects(spark):
    rows = [(i, ("the cat and the dog were there. " if i % 2 else "le chat et le chien sont ici. ") * 30, "en" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert langid.spoken(docs, model).count() == 60
    assert {r["lang"] for r in langid.spoken(docs, model, langs=("fr",)).collect()} == {"fr"}
    odd = docs.union(spark.createDataFrame([(80, "Съешь же ещё этих мягких французских булок. " * 9, None), (81, "{[(=)]};" * 40, None)], docs.schema))
    none = {n: x[2] for n, x in enumerate(langid.predict(model, [r["text"] for r in odd.collect()]))}
    assert {r["doc_id"] for r in langid.spoken(odd, model, none=0.5).collect()} == {r["doc_id"] for n, r in enumerate(odd.collect()) if none[n] <= 0.5} == set(range(60))
    bare = docs.withColumn("lang", F.lit(None).cast("string")).union(spark.createDataFrame([(90, "1 2", None), (91, None, None)], docs.schema))
    assert langid.fit(bare) is None and langid.spoken(bare, None).count() == 60
    with pytest.raises(ValueError):
        langid.spoken(bare, None, langs=("fr",))
    keyless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert langid.fit(keyless).langs == ("en", "fr")


def test_weak_label_scores_against_plain_ones(spark):
    """Posterior and score of each text from the models' definitions, one labeller and one word at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    model, scorer = weaklabel.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slots = weaklabel._Slots()
    for r in weaklabel.scored(docs, model, scorer).collect():
        p = [1 - model.share, model.share]
        for c in (0, 1):
            for i, v in enumerate(weaklabel.votes(texts[r["doc_id"]])):
                p[c] *= model.chance[c, i, v]
        words = texts[r["doc_id"]].encode().split()
        pairs = list(zip(words, words[1:], strict=False))
        at = [x for w in words for x in slots[w]] + [weaklabel.AGAIN] * (len(pairs) - len(set(pairs)))
        score = logistic(sum(float(scorer.weight[x]) for x in at) / (len(at) + weaklabel.CALM) + scorer.bias)
        assert abs(r["posterior"] - p[1] / sum(p)) < 1e-9 and abs(r["score"] - score) < 1e-6 and r["kept"] == (bool(words) and score >= 0.5)


def test_labellers_abstain_without_evidence():
    few = dict(zip(weaklabel.LABELLERS, weaklabel.votes("One plain sentence."), strict=True))
    assert [few[x] for x in ("repeated_lines", "word_length", "function_words", "repeated_runs")] == [weaklabel.SILENT] * 4
    assert set(weaklabel.votes("")) == {0, weaklabel.SILENT}


def test_equal_rows_are_one_example(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(weaklabel, "fit_scorer", lambda rows, labels: seen.append(len(rows)) or weaklabel.Scorer(np.zeros(2 * weaklabel.SPACE + 1), 0.0))
    weaklabel.fit(spark.range(20_000).selectExpr("id as doc_id", "'the same text for all of them' as text"), sample=100)
    assert seen == [1]


def test_suffix_rates_leave_out_the_own_fold(spark):
    rows = [(0, 0, 10, 8, 8), (0, 1, 10, 4, 0), (3, 2, 5, 0, 0), (3, 4, 7, 6, 3)]
    got = urltrees.suffixes(rows)
    for fold in (None, *range(urltrees.FOLDS)):
        use = [r for r in rows if r[1] != fold]
        overall = (sum(r[4] for r in use) + 1) / (sum(r[3] for r in use) + 2)
        for bucket in (0, 3, 9):
            own = [r for r in use if r[0] == bucket]
            want = (sum(r[4] for r in own) + urltrees.PRIOR * overall) / (sum(r[3] for r in own) + urltrees.PRIOR)
            assert abs(got.rate[0 if fold is None else fold + 1, bucket] - want) < 1e-12
    assert abs(np.expm1(got.count[0]) - 20) < 1e-9 and got.count[9] == 0


def test_tree_scores_against_plain_ones(spark):
    """Each URL's features one by one, each tree node by node."""
    urls = [f"http{'s' * (i % 2)}://h{i % 7}.{'com' if i % 3 else 'org'}/{'de' if i % 5 else 'fr'}/{i}?a={i}&b=1#x" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate([*urls, None, "http://other.net/x-y_z"])), "page_id long, url string")
    judge = urltrees.learned(urltrees.placed(pages, RULES, "page_id", "url"))
    placed = {r["key"]: r for r in urltrees.placed(pages, RULES, "page_id", "url").collect()}
    assert 0 < len(judge.forest.trees) <= urltrees.TREES
    for r in urltrees.judged(pages, RULES).collect():
        at = placed[r["page_id"]]
        x = [*urltrees.lexical(at["url"], at["host"], at["path"]), judge.suffixes.rate[0, at["suffix"]], judge.suffixes.count[at["suffix"]]]
        score = judge.forest.base
        for tree in judge.forest.trees:
            node = 0
            while node < len(tree.feature):
                node = 2 * node + (2 if x[tree.feature[node]] > tree.threshold[node] else 1)
            score += urltrees.RATE * tree.value[node - len(tree.feature)]
        assert abs(r["score"] - logistic(score)) < 1e-9
        assert r["verdict"] == (RULES[r["rule"]] if r["rule"] else "block" if r["score"] >= urltrees.LEAST else "allow")


def test_very_long_texts_of_row_operators(spark):
    long = "word " * 300_000
    docs = spark.createDataFrame([(1, long, "a"), (2, "b", "a"), (3, long, None)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mixing.plan(docs).collect()} == {1: 300_000, 2: 1, 3: 300_000}
    pages = spark.createDataFrame([(1, "http://a.com/" + "x/" * 200_000, "<p>" + long)], "page_id long, url string, html string")
    assert warc.derive(warc.responses(pages)).where("record_type = 'conversion'").first()["block"] == long.strip()
    assert urltrees.judged(pages, RULES).first()["path"] == "/" + "x/" * 200_000
