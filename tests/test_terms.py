"""Dictionaries of terms in one pass, decisions and places from their hits."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.functions import lexicon, terms
from quillspark.operators import places
from quillspark.shipping import ROWS


def test_hits_equal_a_search_for_each_term():
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abé漢😀") for _ in range(n))
    for _ in range(300):
        entries = [(f"n{r.randint(0, 3)}", word(r.randint(1, 4))) for _ in range(r.randint(0, 12))]
        text = word(r.randint(0, 40))
        trie = terms.Trie(entries)
        want = [(name, term, sum(text.startswith(term, at) for at in range(len(text))), text.find(term)) for name, term in entries if term in text]
        assert trie.hits(text) == want
        assert sorted(trie.spans(text)) == sorted((t, at, at + len(t)) for t in {t for _, t in entries} for at in range(len(text)) if text.startswith(t, at))


def test_columns(spark):
    rows = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, ""), (4, "dogs and cats"), (4, "dogs and cats")], "id int, text string")
    words = terms.Dictionary([("animal", "cat"), ("animal", "dog"), ("verb", "sat"), ("pet", "cat"), ("none", "")])
    got = sorted(((r.id, r.n, r.c, r.o) for r in rows.select("id", terms.names(words.hits(F.col("text"))).alias("n"), terms.terms_of(words.hits(F.col("text")), "animal").alias("c"), terms.only(terms.names(words.hits(F.col("text")))).alias("o")).collect()), key=str)
    assert got == [(1, ["animal", "verb", "pet"], ["cat"], None), (2, [], [], None), (3, [], [], None), (4, ["animal", "pet"], ["cat", "dog"], None), (4, ["animal", "pet"], ["cat", "dog"], None)]
    assert [len(r[0]) for r in rows.where("id = 4").select(words.spans(F.col("text"))).collect()] == [2, 2]
    assert terms.Dictionary.of(spark.createDataFrame([("b", "x"), ("a", "y"), ("a", None)], "name string, term string"), "name", "term").entries == [("a", "y"), ("b", "x")]
    assert rows.select(terms.names(terms.Dictionary([]).hits(F.col("text")))).distinct().count() == 1
    with pytest.raises(ValueError):
        terms.Dictionary([("x", "y" * (terms.MOST_CHARACTERS + 1))])


def test_decision_equals_that_of_the_columns(spark):
    r = random.Random(3)
    pool = [*lexicon.STRONG_TERMS, *lexicon.BROAD_TERMS, *lexicon.NEGATIVE_TERMS, "办公", "WAF", "Soc "]
    rows = spark.createDataFrame([(n, "，".join(r.sample(pool, r.randint(0, 4)))) for n in range(200)] + [(200, None)], "id int, text string")
    hits = lexicon.lexicon_of().hits(F.lower(F.coalesce("text", F.lit(""))))
    found = rows.select("id", lexicon.rule_decision(F.col("text")).alias("a"), lexicon.rule_decision_of(hits).alias("b"))
    assert found.where("not (a <=> b)").count() == 0


def test_places(spark):
    catalogue = spark.createDataFrame([("吉林省", "长春市", "朝阳区"), ("吉林省", "延边朝鲜族自治州", "延吉市"), ("北京市", "北京市", "朝阳区"), ("辽宁省", "沈阳市", None), ("海南省", None, None), ("吉林省", "吉林市", None)], "province string, city string, district string")
    rows = [
        (1, "吉林-长春", None, None, None), (2, None, None, "长春市第一中学", "朝阳区道路"), (3, None, None, None, "朝阳区道路"), (4, None, None, "延边医院", None),
        (5, None, None, None, "长春市与沈阳市"), (6, "海南省", None, None, "沈阳市设备"), (7, None, " 沈阳 ", None, None), (8, None, None, None, "延吉市设备"), (9, None, None, None, None), (10, "辽宁", None, None, "沈阳"),
    ]
    found = places.located(spark.createDataFrame(rows, "id int, region string, city string, buyer string, title string"), catalogue)
    got = {r.id: (r.province_found, r.city_found, r.district_found) for r in found.collect()}
    assert got == {
        1: ("吉林省", "长春市", ""), 2: ("吉林省", "长春市", "朝阳区"), 3: ("", "", ""), 4: ("吉林省", "延边朝鲜族自治州", ""), 5: ("", "", ""),
        6: ("海南省", "", ""), 7: ("辽宁省", "沈阳市", ""), 8: ("吉林省", "延边朝鲜族自治州", "延吉市"), 9: ("", "", ""), 10: ("辽宁省", "沈阳市", ""),
    }


def test_time_follows_the_text_not_the_terms():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    text = " ".join(word() for _ in range(60_000))
    took = []
    for n in (30, 3000):
        trie = terms.Trie([("x", word()) for _ in range(n)])
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            trie.hits(text)
            best = min(best, time.perf_counter() - start)
        took.append(best)
    assert took[1] < 5 * took[0] + 0.05


def test_long_batches_of_texts_are_taken_in_parts(spark, monkeypatch):
    monkeypatch.setattr(terms.F, "pandas_udf", lambda function, returns: function)
    run = terms.Dictionary([("n", "a")])._function(terms.HITS, "hits")
    found = list(run(iter([pd.Series(["a b", None] * ROWS)])))
    assert [len(x) for x in found] == [ROWS, ROWS] and found[0].tolist() == found[1].tolist() == [[("n", "a", 1, 0)], None] * (ROWS // 2)


def test_one_pass_decides_and_names_as_the_searches_do(spark):
    said = ["防火墙 WAF", "软件", "消防安全 ids", "nothing", None, "等保 审计设备 安全运营", "strong"]
    rules = (*lexicon.CATEGORY_RULES, ("strong", ("strong", "WAF")))
    rows = spark.createDataFrame([(x,) for x in said], "t string")
    hits, verdict, names = lexicon.decision_and_rules(F.col("t"), rules)
    found = rows.withColumn("h", hits).select(verdict(F.col("h")).alias("v"), names(F.col("h"), "other").alias("n")).collect()
    assert found == rows.select(lexicon.rule_decision(F.col("t")).alias("v"), lexicon.all_rules(F.col("t"), rules, "other").alias("n")).collect()


def test_the_plan_of_security_terms_searches_a_text_once(spark, sf, capsys):
    entry.queries()["security_terms"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") and "contains(lower(" not in plan.lower()
