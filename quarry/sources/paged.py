"""A source of paged HTTP queries, for batches and streams, by Spark's Python data source API.

    spark.dataSource.register(PagedSource)
    spark.readStream.format("paged").option("url", ...).load()

Page by page a JSON request is posted; the answer's first line that holds `"items":` is JSON from its first brace on, and its items are rows, as JSON text with their page. The first page without
items ends the source. A page that can't be fetched is left out after a pause. A stream goes on where its checkpoint ends; `first_page` continues a file of items by their number.
"""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Pages and items of a page, the request's kind and fields, and seconds to wait.
PAGES, PAGE_SIZE = 2400, 10
HEADERS = {"accept": "text/x-component", "content-type": "text/plain;charset=UTF-8"}
FIELDS = {"optionDoc": "title", "matchMode": "all_words"}
TIMEOUT, AFTER_ERROR, LEAST_PAUSE, MOST_PAUSE = 15.0, 5.0, 1.5, 3.5


def items_of(body: str) -> list:
    """The items of an answer; none if it holds no such line or that line is no JSON."""
    for line in body.split("\n"):
        if '"items":' in line and "{" in line:
            try:
                return json.loads(line[line.index("{") :]).get("items") or []
            except ValueError:
                return []
    return []


class Pages:
    """The pages of a source by its options: url, size, pages, start, keyword, headers (JSON), timeout, pause_after_error, least_pause, most_pause."""

    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.size, self.last = int(options.get("size", PAGE_SIZE)), int(options.get("pages", PAGES))
        self.start, self.keyword = int(options.get("start", 1)), options.get("keyword", "")
        self.headers = HEADERS | json.loads(options.get("headers", "{}"))
        self.timeout, self.after_error = float(options.get("timeout", TIMEOUT)), float(options.get("pause_after_error", AFTER_ERROR))
        self.least, self.most = float(options.get("least_pause", LEAST_PAUSE)), float(options.get("most_pause", MOST_PAUSE))

    def fetch(self, page: int) -> list | None:
        """The items of a page; None if it can't be fetched."""
        body = json.dumps([{"pageNumber": page, "pageSize": self.size, "keyword": self.keyword} | FIELDS]).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, self.headers, method="POST"), timeout=self.timeout) as answer:
                return items_of(answer.read().decode("utf-8", "replace"))
        except OSError:
            time.sleep(self.after_error)
            return None

    def rows(self, first: int, most: int) -> Iterator[tuple[int, list[tuple[int, str]]]]:
        """(next page, rows) of up to `most` pages; the last page is followed by `last` + 1, as is one without items."""
        for page in range(first, min(self.last, first + most - 1) + 1):
            items = self.fetch(page)
            if items is not None and not items:
                yield self.last + 1, []
                return
            yield page + 1, [(page, json.dumps(x, ensure_ascii=False)) for x in items or []]
            time.sleep(random.uniform(self.least, self.most))


class PagedReader(DataSourceReader):
    """All pages in turn: where they end is known from their content alone, so one task reads them."""

    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.pages.start)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        for _, rows in self.pages.rows(partition.value, self.pages.last):
            yield from rows


class PagedStreamReader(SimpleDataSourceStreamReader):
    """A page a batch; offsets are page numbers."""

    def __init__(self, pages: Pages):
        self.pages = pages

    def initialOffset(self) -> dict:
        return {"page": self.pages.start}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
        for following, rows in self.pages.rows(start["page"], 1):
            return iter(rows), {"page": following}
        return iter([]), start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:
        for _, rows in self.pages.rows(start["page"], end["page"] - start["page"]):
            yield from rows


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(Pages(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStreamReader(Pages(self.options))


def first_page(spark: SparkSession, path: str, size: int = PAGE_SIZE) -> int:
    """The page with which a file of so many items a page goes on; 1 if there is none yet."""
    try:
        return spark.read.text(path).count() // size + 1
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 1


def paged(spark: SparkSession, **options: object) -> DataFrame:
    """page and item (JSON text) of all pages."""
    from quarry.session import ship

    ship(spark)
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(**{k: str(v) for k, v in options.items()}).load()


def crawl(spark: SparkSession, path: str, size: int = PAGE_SIZE, **options: object) -> int:
    """Append the items of the pages that a file of items doesn't hold yet, a line each; the page it began with."""
    start = first_page(spark, path, size)
    paged(spark, start=start, size=size, **options).select("item").write.mode("append").text(path)
    return start
