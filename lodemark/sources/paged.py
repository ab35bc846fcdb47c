"""A dataset that comes in numbered pages, as a data source of Spark: ``spark.read.format("paged")``.

A page is one JSON document, {"page": 7, "items": [...]}, in a file whose name holds its number. A batch
read plans from names alone: conditions on ``page`` leave out files before any is opened, and what is
left is dealt to tasks in runs of pages. A stream's offset is the number of the next page; a restarted
stream goes on behind the last page that it has committed. Pages may arrive in any order up to the first gap:
a stream never passes a page that is not there yet.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lodemark.session import ship

SCHEMA = "page bigint, position bigint, item string"
NUMBER = re.compile(r"page=(\d+)(?:/part-[^/]*|\.json)$")
FILES_A_TASK = 16


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder as Spark names it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]://", "s3://", uri)))


def pages_of(path: str) -> dict[int, list[str]]:
    """The files of each page, by number."""
    fs, root = filesystem(path)
    out: dict[int, list[str]] = {}
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        m = NUMBER.search(info.path)
        if info.is_file and m:
            out.setdefault(int(m[1]), []).append(info.path)
    return out


def read_files(path: str, files: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """One batch a file; an item is passed on as JSON text."""
    fs, _ = filesystem(path)
    for number, name in files:
        with fs.open_input_stream(name) as f:
            items = json.loads(f.read()).get("items") or []
        texts = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in items]
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["page", "position", "item"])


class Pages(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


def _dealt(files: list[tuple[int, str]], size: int) -> list[Pages]:
    return [Pages(files[i : i + size]) for i in range(0, len(files), size)]


class PagedReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.tests: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of ``page``; the others are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("page",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def _wanted(self, page: int) -> bool:
        compare = {EqualTo: lambda v: page == v, In: lambda v: page in v, GreaterThan: lambda v: page > v, GreaterThanOrEqual: lambda v: page >= v, LessThan: lambda v: page < v, LessThanOrEqual: lambda v: page <= v}
        return all(compare[kind](value) for kind, value in self.tests)

    def partitions(self) -> list[Pages]:
        files = sorted((n, f) for n, names in pages_of(self.path).items() if self._wanted(n) for f in names)
        return _dealt(files, self.size) or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return read_files(self.path, partition.files)


class PagedStream(DataSourceStreamReader):
    """Offsets are {"next": number of the first page that is not read yet}."""

    def __init__(self, path: str, size: int, first: int):
        self.path, self.size, self.first, self.seen = path, size, first, first

    def initialOffset(self) -> dict:
        return {"next": self.first}

    def latestOffset(self) -> dict:
        have = pages_of(self.path)
        self.seen = max(self.seen, self.first)
        while self.seen in have:
            self.seen += 1
        return {"next": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.seen = max(self.seen, end["next"])
        have = pages_of(self.path)
        return _dealt([(n, f) for n in range(start["next"], end["next"]) for f in sorted(have[n])], self.size)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return read_files(self.path, partition.files)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """Options: path (the folder), files (files a task, 16), first (a stream's first page, 0)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["path"], int(self.options.get("files", FILES_A_TASK)))

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options["path"], int(self.options.get("files", FILES_A_TASK)), int(self.options.get("first", 0)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def write_pages(df: DataFrame, path: str, page: str, order: str) -> None:
    """The rows of ``df`` as pages below ``path``, one file each; ``page`` numbers them, and a page has to fit a task."""
    item = F.struct(*[c for c in df.columns if c != page])
    rows = df.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))).alias("rows"))
    document = F.to_json(F.struct(F.col(page).alias("page"), F.transform("rows", lambda r: r["x"]).alias("items")))
    rows.select(F.col(page).alias("page"), document.alias("value")).write.mode("overwrite").partitionBy("page").text(path)
