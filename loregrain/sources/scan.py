"""Data sources for ``spark.read`` and ``spark.readStream``: paged sources as landed pages, and a tail of rows by id.

``register(spark)`` makes the formats known. Both read through the file systems of pyarrow, by path or URI.

``landed_pages`` reads pages that were landed as JSON under ``<path>/site=<site>/page=<number>/``, each {"items": [...], "has_more": ...}.
A row is a page: site, page, has_more, items as JSON text, error. One input partition is a site's range of pages. Reading follows a paged API's own rules: a range
ends after the first page without items or without more, and waits ``pause`` seconds between pages. A page that can't be read gives a row with its error and ends
its range; the pages before it stay. ``collected_items`` then applies the rules across ranges and sites, up to the target.

Options of ``landed_pages``: path; sites, comma-separated, in order (all that are there); pages, the most a site has (25); range, pages of a partition (5); pause (0).

``id_tail`` follows Parquet files under ``path``: rows whose ``key`` is above the cursor, in its order, ``limit`` (50) a micro-batch. The cursor is the stream's offset, so that a
restarted query goes on after the last row it has committed. Options: path, key, limit, start (the cursor to begin with, 0).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import from_arrow_schema

PAGE = "site string, page int, has_more boolean, items array<string>, error string"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def whole(options: dict, name: str, default: int, low: int, high: int) -> int:
    """An option that is a number within bounds; anything else is an error before a task starts."""
    try:
        value = int(options.get(name, default))
    except ValueError:
        value = low - 1
    if not low <= value <= high:
        raise ValueError(f"option {name} has to be a whole number from {low} to {high}")
    return value


def needed(options: dict, name: str) -> str:
    if not options.get(name):
        raise ValueError(f"option {name} is missing")
    return options[name]


@dataclass
class PageRange(InputPartition):
    site: str
    first: int
    last: int


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = needed(options, "path").rstrip("/")
        self.sites = [s.strip() for s in options.get("sites", "").split(",") if s.strip()]
        self.most = whole(options, "pages", 25, 1, 10_000)
        self.range = whole(options, "range", 5, 1, 10_000)
        self.pause = whole(options, "pause", 0, 0, 60)

    def partitions(self) -> list[PageRange]:
        """Ranges of the pages that are there; only folder names are listed."""
        fs, path = opened(self.path)
        there = {f.base_name.removeprefix("site="): f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.base_name.startswith("site=")}
        out = []
        for site in self.sites or sorted(there):
            pages = [int(f.base_name[5:]) for f in fs.get_file_info(pyarrow.fs.FileSelector(there[site])) if f.base_name.startswith("page=")] if site in there else []
            last = min(max(pages, default=0), self.most)
            out += [PageRange(site, first, min(first + self.range - 1, last)) for first in range(1, last + 1, self.range)]
        return out

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            if self.pause and page > partition.first:
                time.sleep(self.pause)
            try:
                told = self.fetched(partition.site, page)
                items = [x if isinstance(x, str) else json.dumps(x) for x in told["items"]]
                more = bool(told.get("has_more", True))
            except (OSError, ValueError, KeyError, TypeError) as error:
                yield partition.site, page, None, None, f"{type(error).__name__}: {error}"[:300]
                return
            yield partition.site, page, more, items, None
            if not items or not more:
                return

    def fetched(self, site: str, page: int) -> dict:
        """A page's content; a page is one object, which may be cut into lines of several files."""
        fs, path = opened(f"{self.path}/site={site}/page={page}")
        files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and f.base_name.endswith(".json"))
        text = ""
        for file in files:
            with fs.open_input_stream(file) as stream:
                text += stream.read().decode()
        return json.loads(text)


def collected_items(pages: DataFrame, target: int, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(site, page, place, item) of pages up to target items, by site and page, and of each site (site, n_pages, n_items, error): what was read and what ended it.

    A site ends at its first page with an error, without items or without more; pages of later ranges that were read beyond that don't count. order: the sites' order, else by name.
    """
    ends = F.col("error").isNotNull() | (F.size("items") == 0) | ~F.col("has_more")
    last = pages.where(ends).groupBy("site").agg(F.min("page").alias("last"))
    open_ = pages.join(last, "site", "left").where("last is null or page <= last")
    report = open_.groupBy("site").agg(F.count_if(F.col("error").isNull()).alias("n_pages"), F.sum(F.when(F.col("error").isNull(), F.size("items")).otherwise(0)).alias("n_items"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("error"))
    rank = F.col("site") if not order else F.format_string("%06d", F.array_position(F.array(*map(F.lit, order)), F.col("site")))
    read = open_.where("error is null").withColumn("rank", rank)
    # one number for each page is put in order, and no item
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank", "page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = read.select("site", "page", "rank", F.size("items").alias("n")).withColumn("before", before).where(F.col("before") < target).select("site", "page", "before")
    items = read.join(starts, ["site", "page"]).select("site", "page", "before", F.posexplode("items").alias("i", "item"))
    return items.withColumn("place", F.col("before") + F.col("i")).where(F.col("place") < target).select("site", "page", "place", "item"), report


class IdTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "id_tail"

    def schema(self):
        return from_arrow_schema(_tailed(self.options).schema)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TailReader(dict(self.options))


def _tailed(options: dict) -> ds.Dataset:
    fs, path = opened(needed(options, "path"))
    return ds.dataset(path, filesystem=fs, format="parquet")


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.key = options, needed(options, "key")
        self.limit, self.start = whole(options, "limit", 50, 1, 10_000), whole(options, "start", 0, 0, 1 << 62)

    def initialOffset(self) -> dict:
        return {"id": self.start}

    def _rows(self, above: int, upto: int | None) -> list[tuple]:
        """The first rows above a cursor; memory holds ``limit`` of them and a batch, and statistics of row groups keep the rest unread."""
        wanted = ds.field(self.key) > above
        if upto is not None:
            wanted &= ds.field(self.key) <= upto
        held = None
        for batch in _tailed(self.options).to_batches(filter=wanted):
            table = pyarrow.Table.from_batches([batch] if held is None else [held, batch]).sort_by(self.key)
            held = (table if upto is not None else table.slice(0, self.limit)).combine_chunks().to_batches()
            held = held[0] if held else None
        return list(zip(*(c.to_pylist() for c in held.columns), strict=True)) if held is not None else []

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start["id"], None)
        names = _tailed(self.options).schema.names
        return iter(rows), {"id": rows[-1][names.index(self.key)] if rows else start["id"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["id"], end["id"]))

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    for source in (LandedPages, IdTail):
        spark.dataSource.register(source)
