"""Scan grids, what was read of them, and recorded responses as a data source."""

import base64
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspark.sources import recorded, scan

PAGES = "source string, channel string, window_start date, page int, status int, total_pages int, total_records int, shown int, oldest date, newest date, seq int"
D = date.fromisoformat


@pytest.fixture(scope="module")
def cells(spark):
    plan = spark.createDataFrame([("s", "search", ["a", "b", "a"], 7, 4), ("t", "archive", ["x", "y", "z", "w"], 3, 5), ("none", "search", [], 7, 4)], "source string, kind string, channels array<string>, window_days int, most_pages int")
    return scan.grid(plan, "2026-01-01", "2026-01-10")


def test_grid(cells):
    got = sorted((r.source, r.channel, str(r.window_start), str(r.window_end)) for r in cells.collect())
    assert got == [("s", "a", "2026-01-01", "2026-01-07"), ("s", "a", "2026-01-08", "2026-01-10"), ("s", "b", "2026-01-01", "2026-01-07"), ("s", "b", "2026-01-08", "2026-01-10")] + [("t", c, "2026-01-01", "2026-01-10") for c in "wxyz"]


def test_states(spark, cells):
    first, second, new, old = D("2026-01-01"), D("2026-01-08"), D("2026-01-09"), D("2025-12-30")
    rows = [
        ("s", "a", first, 1, 200, 2, 30, 20, first, new, 1), ("s", "a", first, 2, 200, 2, 30, 10, first, new, 1), ("s", "a", first, 2, 503, 2, 30, 10, first, new, 0),
        ("s", "a", second, 1, 200, 0, 0, 0, None, None, 1),
        ("s", "b", first, 1, 200, 9, 99, 20, first, new, 1), ("s", "b", first, 3, 200, 9, 99, 20, first, new, 1),
        ("s", "b", second, 1, 200, 9, 99, 20, new, new, 1), ("s", "b", second, 2, 200, 1, 99, 20, new, new, 1),
        ("t", "x", first, 1, 200, None, None, 5, new, new, 1), ("t", "x", first, 2, 404, None, None, None, None, None, 1),
        ("t", "y", first, 1, 200, None, None, 5, D("2026-01-02"), new, 1), ("t", "y", first, 2, 200, None, None, 5, old, old, 1),
        ("t", "z", first, 1, 200, None, None, 0, None, None, 1),
        ("u", "x", first, 1, 200, 1, 1, 1, new, new, 1),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    found = scan.states(cells, pages, "2026-01-01", "2026-01-10")
    got = {(r.source, r.channel, r.window_start.day): r for r in found.collect()}
    assert {k: (r.state, r.pages, r.notices, r.reached_start, r.reached_end, r.truncated) for k, r in got.items()} == {
        ("s", "a", 1): ("complete", 2, 30, True, True, False),
        ("s", "a", 8): ("complete", 1, 0, True, True, False),
        ("s", "b", 1): ("gap", 1, 20, False, False, True),
        ("s", "b", 8): ("failed", 1, 20, False, False, True),
        ("t", "w", 1): ("unread", 0, 0, False, False, True),
        ("t", "x", 1): ("boundary", 1, 5, False, True, True),
        ("t", "y", 1): ("complete", 2, 10, True, True, False),
        ("t", "z", 1): ("complete", 1, 0, True, True, False),
    }
    assert [tuple(x) for x in got["s", "b", 1].missing] == [(2, 2), (4, 4)] and not got["t", "x", 1].missing
    assert [(r.source, r.channel) for r in scan.unread(cells, pages).collect()] == [("t", "w")]
    assert [(r.source, r.channel, str(r.first), str(r["last"]), r.windows) for r in scan.covered(found).where("source = 's'").collect()] == [("s", "a", "2026-01-01", "2026-01-10", 2)]
    whole = {r.source: r for r in scan.summary(found, "2026-01-01", "2026-01-10").collect()}
    assert whole["s"].message == "1 lists with an error; 1 lists cut short" and whole["t"].message == "1 lists not read; 1 archives that go back no further"
    assert str(whole["t"].first_date) == "2026-01-01" and whole["s"].truncated
    assert scan.states(cells.limit(0), pages, "2026-01-01", "2026-01-10").count() == 0
    assert {r.state for r in scan.states(cells, pages.limit(0), "2026-01-01", "2026-01-10").collect()} == {"unread"}


def test_pages_at_the_limit(spark, cells):
    rows = [("s", "a", D("2026-01-01"), n, 200, 9, 99, 20, D("2026-01-01"), D("2026-01-01"), 1) for n in range(1, 5)]
    found = scan.states(cells, spark.createDataFrame(rows, PAGES), "2026-01-01", "2026-01-10").where("source = 's' and channel = 'a' and window_start = date '2026-01-01'").first()
    assert found.state == "limit" and found.pages == 4 and found.truncated


CONFIGS = [
    {"name": "low", "type": "ccgp_archive", "authority_rank": 10, "channels": ["x/y", "z"]},
    {"name": "off", "type": "ccgp_search", "enabled": False},
    {"name": "high", "type": "ccgp_search", "authority_rank": 90, "window_days": 5, "channels": ["k", "k", "防火墙"], "most_pages": 3},
    {"type": "url_seed"},
]


def test_configuration():
    found = recorded.configured(CONFIGS)
    assert [s.name for s in found] == ["high", "url_seed", "low"] and found[0].channels == ("k", "防火墙") and found[1].authority_rank == 50
    for bad in ([{"type": "telegram"}], [{"type": "url_seed", "window_days": 0}], [{"type": "url_seed"}, {"type": "url_seed"}]):
        with pytest.raises(ValueError):
            recorded.configured(bad)
    assert recorded.configured([{"type": "telegram", "enabled": False}]) == []


def put(root, source, window, channel, page, seq, **said):
    folder = root / f"source={recorded.quote(source, '')}" / f"window={window}" / f"channel={recorded.quote(channel, '')}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"page-{page}-{seq}.json").write_text(json.dumps({"status": 200, "url": f"https://a.test/{page}", "content_type": "text/html"} | said))


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "high", "2026-01-01", "k", 1, 1, body="one")
    put(tmp_path, "high", "2026-01-06", "防火墙", 2, 2, body_base64=base64.b64encode(b"\xff\x00").decode())
    put(tmp_path, "high", "2026-01-06", "防火墙", 9, 2, body="beyond the plan")
    put(tmp_path, "low", "2026-01-01", "x/y", 1, 3, status=404)
    put(tmp_path, "off", "2026-01-01", "", 1, 3, body="never read")
    return tmp_path


def rows(df):
    return sorted((r.source, r.channel, str(r.window_start), r.page, r.seq, r.status, None if r.body is None else bytes(r.body)) for r in df.collect())


def options(reader, folder):
    return reader.format("recorded").option("sources", json.dumps(CONFIGS)).option("first", "2026-01-01").option("last", "2026-01-10").option("path", str(folder))


def test_recorded_responses(spark, folder):
    recorded.register(spark)
    df = options(spark.read, folder).load()
    want = [("high", "k", "2026-01-01", 1, 1, 200, b"one"), ("high", "防火墙", "2026-01-06", 2, 2, 200, b"\xff\x00"), ("low", "x/y", "2026-01-01", 1, 3, 404, None)]
    assert rows(df) == want
    assert df.rdd.getNumPartitions() == 4 + 1 + 2
    # conditions on cells leave out partitions; others are Spark's
    some = df.where((F.col("source") == "high") & (F.col("window_start") >= "2026-01-06") & (F.col("status") == 200))
    assert some.rdd.getNumPartitions() == 2 and rows(some) == want[1:2]
    assert df.where(F.col("channel").isin("k", "z")).rdd.getNumPartitions() == 3


def test_stream_gives_what_a_batch_gives(spark, folder, tmp_path_factory):
    recorded.register(spark)
    check, out = (str(tmp_path_factory.mktemp(x)) for x in ("check", "out"))

    def run():
        stream = options(spark.readStream, folder).load()
        stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination(120)
        return rows(spark.read.parquet(out))

    assert run() == rows(options(spark.read, folder).load())
    put(folder, "high", "2026-01-01", "k", 1, 4, body="again")
    got = run()
    assert got == rows(options(spark.read, folder).load()) and len(got) == 4


def test_recorded_pages_and_the_grid(spark, folder):
    """What the data source reads is what states() judges."""
    recorded.register(spark)
    pages = options(spark.read, folder).load().withColumns({"total_pages": F.lit(1), "total_records": F.lit(1), "shown": F.when(F.col("status") == 200, 1), "oldest": F.col("window_start"), "newest": F.col("window_start")})
    grid = scan.grid(recorded.planned(spark, CONFIGS, "2026-01-01", "2026-01-10"), "2026-01-01", "2026-01-10")
    got = {(r.source, r.channel, str(r.window_start)): r.state for r in scan.states(grid, pages, "2026-01-01", "2026-01-10").collect()}
    assert got["high", "k", "2026-01-01"] == "complete" and got["high", "防火墙", "2026-01-06"] == "gap" and got["low", "x/y", "2026-01-01"] == "failed" and len(got) == 7
