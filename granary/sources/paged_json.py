"""Paged record source: one input partition per page.

``spark.read.format("paged_json")`` reads pages either from a folder of page files
(``path`` option, sub-folders ``page_offset=N``) or from a REST endpoint (``url`` option,
query parameters ``$limit``, ``$offset``, ``$order``). Every listed folder is a page, whatever
its offset, and is read whole: ``limit`` is the size that is asked for, and only
``max_records`` ends the read. All pages of an endpoint load in parallel, and a lost task simply
fetches its page again. Where the number of records is not known (no ``total``), the last page is
searched for with about 2 log2(pages) requests for one record each while the read is planned; the
partition of the last page goes on until an answer is empty, so records that arrive later are read too.
An endpoint that answers with less than was asked for is asked again for the rest of the page.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE_SIZE = 50_000
ORDER = ":id"
#: An endpoint that still answers this far out does not heed the offset.
MOST_PAGES = 1 << 32


class Page(InputPartition):
    """``size`` is what is asked for; ``follow``: the pages behind it belong to this partition too."""

    def __init__(self, offset: int, size: int, follow: bool = False):
        super().__init__((offset, size, follow))
        self.offset, self.size, self.follow = offset, size, follow


def plan_pages(total: int, page_size: int, max_records: int | None) -> list[tuple[int, int]]:
    """(offset, limit) of every page; the last limit is what remains."""
    end = total if max_records is None else min(total, max_records)
    return [(at, min(page_size, end - at)) for at in range(0, end, page_size)]


def last_page(holds: Callable[[int], bool]) -> int:
    """The last page that holds records (-1: none), if none before it is empty: by doubling, then by halving."""
    if not holds(0):
        return -1
    low, high = 0, 1
    while holds(high):
        low, high = high, 2 * high
        if high > MOST_PAGES:
            raise ValueError("the endpoint answers at any offset")
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def _records(body: str) -> list[dict]:
    """The records of a page; anything but a list holds none."""
    data = json.loads(body) if body.strip() else []
    return data if isinstance(data, list) else []


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Page]:
        size = int(self.options.get("limit", PAGE_SIZE))
        end = self._end()
        if "path" in self.options:
            fs, root = FileSystem.from_uri(self.options["path"])
            names = (f.base_name for f in fs.get_file_info(FileSelector(root)) if f.base_name.startswith("page_offset="))
            offsets = sorted(int(d.split("=")[1]) for d in names)
            return [Page(o, size) for o in offsets if end is None or o < end]
        if "total" in self.options:
            return [Page(o, n) for o, n in plan_pages(int(self.options["total"]), size, end)]
        last = last_page(lambda k: (end is None or k * size < end) and bool(_records(self.fetch(k * size, 1))))
        return [Page(k * size, size, follow=k == last) for k in range(last + 1)] or [Page(0, size)]

    def _end(self) -> int | None:
        cap = self.options.get("max_records")
        return int(cap) if cap else None

    def fetch(self, offset: int, size: int) -> str:
        """The body of one page of the endpoint."""
        params = {"$limit": size, "$offset": offset, "$order": self.options.get("order", ORDER)}
        params.update(json.loads(self.options.get("extra_params", "{}")))
        with urllib.request.urlopen(f"{self.options['url']}?{urllib.parse.urlencode(params)}", timeout=60) as reply:
            return reply.read().decode("utf-8")

    def _pages(self, page: Page) -> Iterator[list[dict]]:
        if "path" in self.options:
            fs, root = FileSystem.from_uri(self.options["path"])
            found = fs.get_file_info(FileSelector(f"{root}/page_offset={page.offset}", allow_not_found=True))
            for info in sorted(found, key=lambda f: f.base_name):
                if not info.base_name.startswith((".", "_")):
                    with fs.open_input_stream(info.path) as f:
                        yield _records(f.read().decode("utf-8"))
            return
        at, end = page.offset, self._end()
        if not page.follow:
            end = at + page.size if end is None else min(end, at + page.size)
        while end is None or at < end:
            size = page.size if end is None else min(page.size, end - at)
            records = _records(self.fetch(at, size))[:size]
            if not records:
                return
            yield records
            at += len(records)

    def read(self, partition: Page) -> Iterator[tuple]:
        at, end = partition.offset, self._end()
        for records in self._pages(partition):
            for record in records:
                if end is not None and at >= end:
                    return
                at += 1
                yield tuple(_shape(record.get(f.name), f.dataType.typeName()) for f in self.schema.fields)


def _shape(value, kind: str):
    if value is None:
        return None
    if kind in ("long", "integer"):
        return int(value)
    if kind == "double":
        return float(value)
    return value if isinstance(value, str) else json.dumps(value)


class PagedJson(DataSource):
    """Records take the columns of the given schema; absent keys are NULL."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
