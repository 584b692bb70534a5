"""A Python data source for providers of papers: `spark.read.format("papers")`.

Options: path (a folder or file of JSON lines, one work each, in any file system that pyarrow
knows by its address: a fixture or a dump), provider (arxiv, openalex or semantic; several with
commas), limit (works of each provider), interval (seconds between calls). A dump is read by one
task for each file and provider; with a limit or an interval, which count over all of a
provider's works, by one task for each provider. `place` counts the works of a file, after the
file's own number. Filters on provider and year are pushed into the reader.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from paperloom.sources.limiter import RateLimiter

SCHEMA = "provider string, place bigint, paper_id string, title string, year int, raw string"
#: Names of id, title and year, by provider.
NAMES = {"arxiv": ("arxiv_id", "title", "published"), "openalex": ("id", "title", "publication_year"), "semantic": ("paperId", "title", "year")}


def _files(path: str) -> list[str]:
    system, inside = _system(path)
    if system.get_file_info(inside).type == fs.FileType.File:
        return [inside]
    found = system.get_file_info(fs.FileSelector(inside))
    return sorted(f.path for f in found if f.is_file and posixpath.splitext(f.path)[1] in (".jsonl", ".json", ".txt") and f.size)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    address = path if "://" in path or path.startswith("/") else posixpath.abspath(path)
    return fs.FileSystem.from_uri(address.replace("file:///", "/").replace("file:/", "/", 1) if address.startswith("file:") else address)


def _works(path: str, name: str) -> Iterator[tuple[str, dict]]:
    """Raw line and work of every readable line of a file; bad lines are passed over."""
    with _system(path)[0].open_input_stream(name) as f:
        for line in io.TextIOWrapper(io.BufferedReader(f), encoding="utf-8", newline="\n"):
            try:
                work = json.loads(line)
            except ValueError:
                continue
            if isinstance(work, dict):
                yield line.strip(), work


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.providers = [p.strip() for p in options.get("provider", ",".join(NAMES)).split(",") if p.strip()]
        self.limit = int(options.get("limit", 10**9))
        self.interval = float(options.get("interval", 0))
        self.first: int | None = None
        self.last: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if isinstance(f, EqualTo) and name == ("provider",):
                self.providers = [p for p in self.providers if p == f.value]
            elif isinstance(f, GreaterThanOrEqual) and name == ("year",):
                self.first = f.value
                yield f  # works of unknown year are for Spark to decide
            elif isinstance(f, LessThanOrEqual) and name == ("year",):
                self.last = f.value
                yield f
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = list(enumerate(_files(self.path)))
        if self.interval or self.limit < 10**9:
            parts = [(p, files) for p in self.providers]
        else:
            parts = [(p, [f]) for p in self.providers for f in files]
        return [InputPartition(p) for p in parts] or [InputPartition((None, []))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        provider, files = partition.value
        if provider not in NAMES:
            return
        ident, title, year = NAMES[provider]
        limiter = RateLimiter(self.interval) if self.interval else None
        place = 0
        for number, raw, work in ((n, raw, work) for n, name in files for raw, work in _works(self.path, name)):
            if ident not in work or place >= self.limit:
                continue
            when = str(work.get(year) or "")[:4]
            when = int(when) if when.isdigit() else None
            if when is not None and (self.first is not None and when < self.first or self.last is not None and when > self.last):
                continue
            if limiter and place % 25 == 0:  # a page
                limiter.wait()
            place += 1
            yield provider, (number << 40) + place, str(work[ident] or ""), str(work.get(title) or ""), when, raw


class PapersDataSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make format("papers") known, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PapersDataSource)
