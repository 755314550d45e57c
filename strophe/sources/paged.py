"""A paginated source as a Spark data source: runs of pages as partitions, an end by the total that every page tells.

`fetch(location, page)` gives a page as JSON text: {"data": [...], "meta": {"pagination": {"current_page": n,
"total_pages": m}}}. The first page is fetched on the driver for the total; the others are fetched by tasks, side by side. A table has at most
MOST_PARTS partitions (option "parts" for another number), so tasks do not grow with the pages; a task holds one page at a time.
The recorded form reads page-<n>.json from a folder; a client of a service is another `fetch`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


#: Partitions of a table at most.
MOST_PARTS = 256


def recorded(location: str, page: int) -> str:
    """A page from a folder of any file system that Arrow knows."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(location)
    with files.open_input_stream(f"{path.rstrip('/')}/page-{page}.json") as f:
        return f.read().decode()


def paging(text: str, page: int, location: str) -> tuple[list[dict], int]:
    """Rows and total of a page; a page that is not the one asked for raises."""
    content = json.loads(text)
    place = content["meta"]["pagination"]
    if place["current_page"] != page:
        raise ValueError(f"{location} gave page {place['current_page']} for page {page}")
    return content["data"], place["total_pages"]


class Pages(InputPartition):
    """The pages from `first` to `last`."""

    def __init__(self, first: int, last: int, total: int):
        super().__init__(first)
        self.first, self.last, self.total = first, last, total


class PageReader(DataSourceReader):
    def __init__(self, fetch: Callable[[str, int], str], location: str, schema: StructType, parts: int):
        self.fetch, self.location, self.names, self.parts = fetch, location, schema.fieldNames(), parts

    def partitions(self) -> list[InputPartition]:
        total = paging(self.fetch(self.location, 1), 1, self.location)[1]
        n = min(total, self.parts)
        return [Pages(i * total // n + 1, (i + 1) * total // n, total) for i in range(n)] or [Pages(1, 1, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            rows, total = paging(self.fetch(self.location, page), page, self.location)
            if total != partition.total:
                raise ValueError(f"{self.location} has {total} pages now and had {partition.total}")
            for row in rows:
                yield tuple(row.get(n) for n in self.names)


def paged_source(name: str, fetch: Callable[[str, int], str] = recorded) -> type[DataSource]:
    """A data source of this name, for spark.dataSource.register; give it the columns with .schema(...) and the place with .load(...). Fields that a row lacks are null, others are left out."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def reader(self, schema: StructType) -> DataSourceReader:
            return PageReader(fetch, self.options["path"], schema, int(self.options.get("parts", MOST_PARTS)))

    return Paged
