"""A batch source of web pages: spark.read.format("web_pages").option("urls", "...").

Urls are parted by host, one partition each, so that a host is asked politely in turn while hosts
are read side by side. A page that fails gives a row with a null body.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.delay, self.timeout = float(options.get("delay", "2")), float(options.get("timeout", "30"))

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Host(u) for u in hosts.values()]

    def read(self, partition: _Host) -> Iterator[tuple]:
        from urllib.request import Request, urlopen

        for i, url in enumerate(partition.urls):
            if i:
                time.sleep(self.delay)
            try:
                with urlopen(Request(url, headers={"User-Agent": "corpusloom"}), timeout=self.timeout) as page:
                    yield url, page.status, page.read().decode(page.headers.get_content_charset() or "utf-8", "replace")
            except (OSError, ValueError):
                yield url, None, None


class WebPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return "url string, status int, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
