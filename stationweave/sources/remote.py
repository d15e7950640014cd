"""Remote tables and files over HTTP: a paced, retrying fetch, and a data source that reads text lines from URLs.

    spark.dataSource.register(HttpLines)
    spark.read.format("httplines").option("urls", "http://.../a.csv http://.../b.csv").load()

Each URL is one partition, read and retried by its task; the request rate is
divided among them.
"""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Requests a second to one server, tries of a request, and seconds before the second try; each later one waits twice as long.
RATE, TRIES, WAIT_S = 5.0, 4, 0.5


class Pace:
    """At most `rate` calls a second: wait() returns when the next is due."""

    def __init__(self, rate: float = RATE, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1.0 / rate, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def opened(url: str, pace: Pace | None = None, tries: int = TRIES, wait_s: float = WAIT_S, timeout: float = 60.0):
    """An open response. Server errors and broken connections are tried again, a missing page (4xx) isn't."""
    for k in range(tries):
        if pace:
            pace.wait()
        try:
            return urllib.request.urlopen(url, timeout=timeout)  # noqa: S310 - the caller's URL
        except urllib.error.HTTPError as e:
            if e.code < 500 or k == tries - 1:
                raise
        except OSError:
            if k == tries - 1:
                raise
        time.sleep(wait_s * 2**k)
    raise AssertionError("unreachable")


def download(url: str, path: str, pace: Pace | None = None, **how) -> int:
    """Fetch a file by blocks under another name and rename it when it's whole; gives its size."""
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    try:
        with opened(url, pace, **how) as r, open(part, "wb") as f:
            while block := r.read(1 << 20):
                f.write(block)
                size += len(block)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return size


class HttpLines(DataSource):
    """(url string, line_no bigint, value string) of text resources. Options: urls (blank between), rate, header (lines to skip)."""

    @classmethod
    def name(cls) -> str:
        return "httplines"

    def schema(self) -> str:
        return "url string, line_no bigint, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LineReader(self.options)


class _LineReader(DataSourceReader):
    def __init__(self, options):
        self.urls = options.get("urls", "").split()
        self.rate = float(options.get("rate", RATE))
        self.header = int(options.get("header", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pace = Pace(self.rate / max(len(self.urls), 1))
        with opened(partition.value, pace) as r:
            for n, line in enumerate(r):
                if n >= self.header:
                    yield partition.value, n, line.decode("utf-8", errors="replace").rstrip("\r\n")


def http_lines(spark: SparkSession, urls: list[str], rate: float = RATE, header: int = 0) -> DataFrame:
    """Text lines of URLs; parse them with from_csv or the parsers of sources.fixed."""
    spark.dataSource.register(HttpLines)
    return spark.read.format("httplines").options(urls=" ".join(urls), rate=str(rate), header=str(header)).load()
