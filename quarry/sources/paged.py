"""Paged exports as a Spark data source.

An export is a folder of page files as an API gave them, one JSON document a
page, with its records in a list (``issues`` or ``results``), optionally under
their first record's number (``startAt`` / ``start``).  Each page file is a
partition: a task reads its page only, whatever the others hold.

    register(spark)
    spark.read.format("paged_export").option("path", folder).option("kind", "issues").load()

Equality filters on the top-level strings (``project``, ``key``, ``space``,
``id``) are pushed to the pages: records that fail them never become rows, and a
page that names its project or space is skipped whole.  ``limit`` keeps the
records whose number in the export is below it (the numbers come from the pages,
so tasks need not agree on anything).  Files are reached through Arrow's file
systems (local, HDFS, S3); nothing is fetched from an API.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

# worker-side code travels by value: workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMAS = {"issues": "key string, project string, fields struct<description:string>",
           "pages": "id string, space string, body struct<storage:struct<value:string>>"}
#: Where a page keeps its records, and the number of its first one.
RECORDS, FIRST = ("issues", "results", "values"), ("startAt", "start")


def _filesystem(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Page(InputPartition):
    file: str
    number: int

    def __post_init__(self):
        super().__init__(self.file)


class PagedExport(DataSource):
    """Options: ``path``, ``kind`` (``issues`` or ``pages``), ``limit``,
    ``page_size`` (of pages that do not state their first record's number)."""

    @classmethod
    def name(cls) -> str:
        return "paged_export"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "issues")]

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "issues")
        if self.kind not in SCHEMAS:
            raise ValueError("kind must be 'issues' or 'pages'")
        self.limit = int(options["limit"]) if "limit" in options else None
        self.page_size = int(options["page_size"]) if "page_size" in options else None
        self.group = "project" if self.kind == "issues" else "space"
        self.wanted: list[tuple[str, str]] = []

    def pushFilters(self, filters) -> Iterator:
        names = ("key", "project") if self.kind == "issues" else ("id", "space")
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in names:
                self.wanted.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        where, folder = _filesystem(self.path)
        files = sorted(i.path for i in where.get_file_info(fs.FileSelector(folder)) if i.is_file and i.base_name.endswith(".json"))
        return [Page(f, n) for n, f in enumerate(files)]

    def read(self, partition: Page) -> Iterator[tuple]:
        where, _ = _filesystem(self.path)
        with where.open_input_stream(partition.file) as stream:
            page = json.loads(stream.read())
        for name, value in self.wanted:
            if name == self.group and page.get(name, value) != value:
                return
        at = next((page[k] for k in FIRST if k in page), None)
        if at is None and self.limit is not None:
            if self.page_size is None:
                raise ValueError("paged_export: a limit needs pages that state their first record's number, or page_size")
            at = partition.number * self.page_size
        for i, r in enumerate(next((page[k] for k in RECORDS if k in page), [])):
            if self.limit is not None and at + i >= self.limit:
                return
            group = _text(r.get(self.group, page.get(self.group)))
            own = _text(r.get("key" if self.kind == "issues" else "id"))
            values = {"key": own, "id": own, self.group: group}
            if any(values[name] != value for name, value in self.wanted):
                continue
            if self.kind == "issues":
                fields = r.get("fields")
                yield own, group, None if fields is None else (fields.get("description"),)
            else:
                body = r.get("body")
                store = None if body is None else body.get("storage")
                yield own, group, None if body is None else (None if store is None else (store.get("value"),),)


def _text(value) -> str | None:
    return None if value is None else str(value)


def register(spark: SparkSession) -> None:
    """Make ``paged_export`` known to the session, with filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedExport)
