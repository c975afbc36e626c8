"""Picture search pages and picture files over HTTP, as a data source and an Arrow map.

``PagedSearch`` reads result pages query by query, one partition a query. ``option("fixture", folder)``
reads ``<folder>/<query>/<page>.json`` instead of the network. Fetching is a parameter of ``download``.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Api:
    """How a search service pages, and what its refusals mean."""

    url: str
    results: str
    per_page: int
    max_pages: int
    #: Statuses at which one waits so many seconds and passes over the page.
    waits: tuple[tuple[int, int], ...]
    header: str
    prefix: str
    #: Seconds between pages.
    pause: float = 0.35
    #: A response header with the calls that are left, and waits (calls below, seconds).
    remaining: str = ""
    back_off: tuple[tuple[int, int], ...] = ()


APIS = {
    "pexels": Api("https://api.pexels.com/v1/search", "photos", 80, 50, ((429, 60),), "Authorization", ""),
    "unsplash": Api("https://api.unsplash.com/search/photos", "results", 30, 59, ((403, 3600),), "Authorization", "Client-ID ", 1.0, "x-ratelimit-remaining", ((5, 60), (10, 5))),
}


class QueryPart(InputPartition):
    def __init__(self, query: str):
        self.query = query


class PagedSearch(DataSource):
    """``query, page, record``: a search service's records as JSON. Options: api (of APIS), queries (one a
    line), max_per_query, key, fixture."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "query string, page int, record string"

    def reader(self, schema: StructType) -> SearchReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.api = APIS[options["api"]]
        self.queries = [q for q in options["queries"].split("\n") if q]
        self.most = int(options.get("max_per_query", 1 << 30))
        self.fixture, self.key = options.get("fixture"), options.get("key", "")

    def partitions(self) -> list[QueryPart]:
        return [QueryPart(q) for q in self.queries]

    def _page(self, query: str, page: int) -> tuple[dict, float]:
        """A page, and the seconds to wait after it."""
        if self.fixture:
            from weftline.sources.shards import _open

            with _open(f"{self.fixture}/{query}/{page}.json") as f:
                data = json.loads(f.read())
            if "status" in data:
                raise urllib.error.HTTPError(query, data["status"], "as recorded", None, None)
            return data, 0.0
        url = self.api.url + "?" + urllib.parse.urlencode({"query": query, "per_page": self.api.per_page, "page": page})
        request = urllib.request.Request(url, headers={self.api.header: self.api.prefix + self.key})
        with urllib.request.urlopen(request, timeout=30) as answer:
            left = int(answer.headers.get(self.api.remaining, 1 << 30)) if self.api.remaining else 1 << 30
            wait = next((s for n, s in self.api.back_off if left < n), self.api.pause)
            return json.loads(answer.read()), wait

    def read(self, partition: QueryPart) -> Iterator[tuple]:
        taken = 0
        for page in range(1, self.api.max_pages + 1):
            if taken >= self.most:
                return
            try:
                data, wait = self._page(partition.query, page)
            except urllib.error.HTTPError as e:
                seconds = dict(self.api.waits).get(e.code)
                if seconds is None:
                    return
                time.sleep(0 if self.fixture else seconds)
                continue  # that page stays unread
            except (OSError, ValueError):
                return
            records = data.get(self.api.results) or []
            for record in records:
                yield partition.query, page, json.dumps(record)
            taken += len(records)
            more = data.get("next_page") if "next_page" in data or self.api.results == "photos" else page < data.get("total_pages", 0)
            if not records or not more:
                return
            time.sleep(wait)


def pexels_rows(found: DataFrame, least: int = 512) -> DataFrame:
    """Photographs at least ``least`` pixels a side with a picture to load, each id once."""
    g = lambda path: F.get_json_object("record", f"$.{path}")
    some = lambda *paths: F.coalesce(*(F.nullif(g(p), F.lit("")) for p in paths))
    rows = found.select(
        g("id").alias("pexels_id"), F.coalesce(g("photographer"), F.lit("")).alias("photographer"), F.coalesce(g("url"), F.lit("")).alias("url_page"),
        some("src.large2x", "src.original").alias("image_url"), g("width").cast("int").alias("width"), g("height").cast("int").alias("height"),
        "query", F.coalesce(g("alt"), F.lit("")).alias("caption"), "page",
    )
    return _once(rows.where((F.col("width") >= least) & (F.col("height") >= least) & F.col("image_url").isNotNull()), "pexels_id")


def unsplash_rows(found: DataFrame, least: int = 512) -> DataFrame:
    """As ``pexels_rows``; the caption is the description or else the alternative text."""
    g = lambda path: F.get_json_object("record", f"$.{path}")
    some = lambda *paths: F.coalesce(*(F.nullif(g(p), F.lit("")) for p in paths))
    rows = found.select(
        g("id").alias("unsplash_id"), F.coalesce(g("user.name"), F.lit("")).alias("photographer"), F.coalesce(g("links.html"), F.lit("")).alias("url_page"),
        some("urls.regular", "urls.full").alias("image_url"), g("width").cast("int").alias("width"), g("height").cast("int").alias("height"),
        "query", F.coalesce(some("description", "alt_description"), F.lit("")).alias("caption"), "page",
    )
    return _once(rows.where((F.col("width") >= least) & (F.col("height") >= least) & F.col("image_url").isNotNull()), "unsplash_id")


def _once(rows: DataFrame, key: str) -> DataFrame:
    from weftline.operators.tables import first_per_key

    return first_per_key(rows, key, "query", "page").drop("page")


def acceptable(content_type: Column, size: Column, least: int = 1000, most: int = 50_000_000) -> Column:
    """Whether an answer is a picture of a sensible size."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (F.contains(kind, F.lit("image")) | F.contains(kind, F.lit("octet"))) & (size >= least) & (size <= most)


def fetch(url: str, timeout: float = 15, most: int = 50_000_000) -> tuple[str, bytes]:
    """Content type and body; no more than ``most`` bytes and one are read."""
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; research-bot)"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.headers.get("content-type", ""), answer.read(most + 1)


def download(urls: DataFrame, get: Callable[[str], tuple[str, bytes]] = fetch, threads: int = 16, column: str = "url") -> DataFrame:
    """``url, content_type, size, content`` of the acceptable answers; urls that fail have no row. Rows of a
    batch are loaded by ``threads`` at once, so small batches bound memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(url: str):
            try:
                return get(url)
            except Exception:  # any failure of one address
                return None

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, threads):
                    names = [u for u in batch.column(0).slice(at, threads).to_pylist() if u]
                    got = [(u, *x) for u, x in zip(names, pool.map(one, names), strict=True) if x is not None]
                    yield pa.record_batch([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([len(g[2]) for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], ["url", "content_type", "size", "content"])

    found = urls.select(F.col(column).alias("url")).where("url <> ''").distinct().mapInArrow(run, "url string, content_type string, size long, content binary")
    return found.where(acceptable(F.col("content_type"), F.col("size")))
