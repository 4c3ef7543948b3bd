"""Recorded responses as a Spark data source, for batches and streams: one partition for each cell of a scan's grid.

Responses lie under a folder, which may be on any file system that pyarrow opens by address, as
``source=<name>/window=<day>/channel=<name>/page-<page>-<seq>.json``, names as in a URL's path; ``seq`` grows with each
recording. A file is one JSON object: status, url, content_type, body (text) or body_base64. Sources are configured, not
found: a list of objects with name, type, and optionally enabled, authority_rank, window_days, channels and most_pages.

    recorded.register(spark)
    spark.read.format("recorded").option("sources", json.dumps(configs)).option("first", "2026-01-01").option("last", "2026-01-31").load(path)

Conditions on source, type, channel and windows prune cells before any folder is listed.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator, Sequence
from datetime import date, timedelta
from typing import NamedTuple
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..shipping import ship

#: The types of sources and how their lists are read.
TYPES = {"ccgp_search": "search", "national_ggzy": "search", "jilin_ggzy": "search", "ccgp_archive": "archive", "custom_web": "archive", "url_seed": "archive"}
SCHEMA = "source string, type string, authority_rank int, channel string, window_start date, window_end date, page int, seq long, status int, url string, content_type string, body binary"
PAGE = re.compile(r"page-([0-9]+)-([0-9]+)\.json$")


class Source(NamedTuple):
    """One configured source."""

    name: str
    type: str
    authority_rank: int = 50
    window_days: int = 31
    channels: tuple[str, ...] = ("",)
    most_pages: int = 100

    @property
    def kind(self) -> str:
        return TYPES[self.type]


def configured(configs: Sequence[dict]) -> list[Source]:
    """The sources of a scan: disabled ones go, an unknown type is an error, those of higher authority come first, equal ones as they are given."""
    found = []
    for config in configs:
        if not config.get("enabled", True):
            continue
        if config.get("type") not in TYPES:
            raise ValueError(f"unknown type of source: {config.get('type')}")
        values = {k: config[k] for k in Source._fields if k in config}
        source = Source(**({"name": config["type"]} | values | {"channels": tuple(dict.fromkeys(values.get("channels", ("",))))}))
        if source.window_days < 1 or source.most_pages < 1:
            raise ValueError(f"{source.name}: window_days and most_pages must be at least 1")
        found.append(source)
    if len({s.name for s in found}) < len(found):
        raise ValueError("two sources have one name")
    return sorted(found, key=lambda s: -s.authority_rank)


class Cell(InputPartition):
    """One list: a source's channel in a window of days; in streams, what was recorded after one number up to another."""

    def __init__(self, source: Source, channel: str, start: date, end: date, after: int = -1, upto: int | None = None) -> None:
        self.source, self.channel, self.start, self.end, self.after, self.upto = source, channel, start, end, after, upto

    def folder(self, root: str) -> str:
        return f"{root}/source={quote(self.source.name, '')}/window={self.start}/channel={quote(self.channel, '')}"


def cells(sources: Sequence[Source], first: date, last: date) -> Iterator[Cell]:
    """The planned grid: windows from the first day on, the last one cut; an archive has one window."""
    for source in sources:
        start = first
        while start <= last:
            end = last if source.kind == "archive" else min(last, start + timedelta(days=source.window_days - 1))
            for channel in source.channels:
                yield Cell(source, channel, start, end)
            start = end + timedelta(days=1)


_TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
_ON_CELLS = {"source": lambda c: c.source.name, "channel": lambda c: c.channel, "window_start": lambda c: c.start, "window_end": lambda c: c.end, "type": lambda c: c.source.type}


class _Folder:
    """What batches and streams share: options, the file system, and reading one cell."""

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.sources = configured(json.loads(options["sources"]))
        self.first, self.last = date.fromisoformat(options["first"]), date.fromisoformat(options["last"])

    def system(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path[5:])
        return fs.LocalFileSystem(), self.path

    def files(self, cell: Cell) -> list[tuple[int, int, str]]:
        """(page, seq, path) of a cell's recordings, in order; pages beyond the plan's limit aren't looked at."""
        system, root = self.system()
        found = []
        for info in system.get_file_info(fs.FileSelector(cell.folder(root.rstrip("/")), allow_not_found=True)):
            if m := PAGE.search(info.path):
                page, seq = int(m[1]), int(m[2])
                if page <= cell.source.most_pages and seq > cell.after and (cell.upto is None or seq <= cell.upto):
                    found.append((page, seq, info.path))
        return sorted(found)

    def read(self, cell: Cell) -> Iterator[tuple]:
        system, _ = self.system()
        for page, seq, path in self.files(cell):
            with system.open_input_stream(path) as file:
                said = json.loads(file.read())
            body = base64.b64decode(said["body_base64"]) if "body_base64" in said else said["body"].encode() if said.get("body") is not None else None
            yield cell.source.name, cell.source.type, cell.source.authority_rank, cell.channel, cell.start, cell.end, page, seq, said.get("status"), said.get("url"), said.get("content_type"), body


class _Reader(_Folder, DataSourceReader):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.planned = list(cells(self.sources, self.first, self.last))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the cells that can fit; a cell fits as a whole or not at all, so such a condition needs no second look."""
        for f in filters:
            test, of = _TESTS.get(type(f)), _ON_CELLS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if test and of:
                self.planned = [c for c in self.planned if test(of(c), f.value)]
            else:
                yield f

    def partitions(self) -> Sequence[Cell]:
        return self.planned


class _Stream(_Folder, DataSourceStreamReader):
    """Recordings in the order of their numbers: an offset is the highest number that there is."""

    def initialOffset(self) -> dict:
        return {"seq": -1}

    def latestOffset(self) -> dict:
        top = max((seq for c in cells(self.sources, self.first, self.last) for _, seq, _ in self.files(c)), default=-1)
        return {"seq": top}

    def partitions(self, start: dict, end: dict) -> Sequence[Cell]:
        rows = (Cell(c.source, c.channel, c.start, c.end, start["seq"], end["seq"]) for c in cells(self.sources, self.first, self.last))
        return [c for c in rows if self.files(c)]


class Recorded(DataSource):
    """The data source; options path, sources, first and last."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def register(spark) -> None:
    """Makes the format known to a session, which from then on hands conditions to such sources, and sends this package to its workers."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recorded)


def planned(spark, sources: Sequence[dict], first: str, last: str):
    """The plan that scan.grid() takes, of the same configuration."""
    rows = [(s.name, s.kind, list(s.channels), s.window_days, s.most_pages) for s in configured(sources)]
    return spark.createDataFrame(rows, "source string, kind string, channels array<string>, window_days int, most_pages int")

