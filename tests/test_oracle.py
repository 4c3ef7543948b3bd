"""Every query that has SQL gives the rows that DuckDB gives for it."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(frame):
    return sorted((tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_of_the_catalogue_has_sql():
    assert not [k for k in QUERIES if k not in SQL and not k.startswith("op") and k != "pipeline"]


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "o_orderkey"


def test_titles_with_entities_are_those_of_their_pages(spark, tmp_path):
    page = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p>A page of some forty letters or more, of no meaning.</p></body></html>"
    titles = ("Now &amp;&amp;&amp; and *** then,&amp;&amp;&amp; the&amp;&", "&amp;&amp;&lt;", "Plain words of a title")
    made = [(i, f"https://a.example.net/{i}", page.format(titles[i % 3])) for i in range(21)]
    spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got, want = QUERIES["mime_magic_verdict"](spark, str(tmp_path)).toPandas(), connection.sql(SQL["mime_magic_verdict"]).df()
    assert rows(got) == rows(want)


def test_pages_whose_titles_are_cut_within_an_entity_have_the_rows_of_sql(spark, tmp_path):
    page = '<html><head><title>{0}</title></head><body><ul><li><a href="/a?b=1&lt=2">x</a></li></ul><h1>{0}</h1><p>{0}</p> of a page.&copy; 1</body></html>'
    whole = ("token = &quot;", "a &lt;", "a &gt;", "it&#x27;", "it&#39;", "you &amp;&amp;", "&amp;quot", "&amp;lt; b")
    titles = sorted({x[:n] for x in whole for n in range(1, len(x) + 1)} | {"&quot9 a", "&lt b&gt c", "&ampere", "&amp&quot;&quot"})
    made = [(i, f"https://a.example.net/{i}", page.format(x)) for i, x in enumerate(titles)]
    spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got, want = QUERIES["html_parsed"](spark, str(tmp_path)).toPandas(), connection.sql(SQL["html_parsed"]).df()
    assert rows(got) == rows(want)
