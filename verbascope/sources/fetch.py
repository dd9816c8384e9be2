"""HTTP as a data source of Spark: `spark.read.format("http_lines")`, one task a URL, retried with growing pauses."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, timeout: float = 120, retries: int = 4, pause: float = 3, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> bytes:
    """The body of `url`, checked against its announced length; a failure is retried after pause, 2 * pause, ..."""
    for attempt in range(1, retries + 1):
        try:
            with opener(url, timeout=timeout) as answer:
                body, length = answer.read(), answer.headers.get("Content-Length")
            if length is not None and int(length) != len(body):
                raise OSError(f"{url}: {len(body)} of {length} bytes")
            return body
        except OSError:
            if attempt == retries:
                raise
            sleep(pause * attempt)
    raise ValueError("retries must be positive")


def fetch_json(url: str, **settings):
    """The JSON behind `url`."""
    import json

    return json.loads(fetch(url, **settings).decode())


def fetch_rows(url: str, least: int = 1, **settings) -> list[list[str]] | None:
    """The rows of a TSV behind `url` that have at least `least` columns; None if it cannot be fetched. Bytes that are no UTF-8 are replaced."""
    try:
        text = fetch(url, **settings).decode(errors="replace")
    except (OSError, ValueError):
        return None
    return [row for line in text.split("\n") if len(row := line.rstrip("\r").split("\t")) >= least and line]


class HttpLines(DataSource):
    """Lines of text behind URLs (option `urls`, separated by blanks), gunzipped if they end in .gz."""

    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def schema(self) -> str:
        return "url string, line_no bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options.get("urls", "").split(), int(self.options.get("retries", 4)), float(self.options.get("pause", 3)))


class HttpReader(DataSourceReader):
    def __init__(self, urls: list[str], retries: int, pause: float):
        self.urls, self.retries, self.pause = urls, retries, pause

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(url) for url in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import gzip

        body = fetch(partition.value, retries=self.retries, pause=self.pause)
        text = (gzip.decompress(body) if partition.value.endswith(".gz") else body).decode()
        for number, line in enumerate(text.splitlines()):
            yield partition.value, number, line
