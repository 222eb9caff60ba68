"""A batch source of paged listings: spark.read.format("paged_listing").option("urls", "...").

A listing's page names its next one by a cursor, so the pages of one listing come one after another, in one task, and listings of different
hosts side by side. A page that fails gives a row with a null value, and ends its listing, as the cursor is lost.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Listings(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def next_url(url: str, parameter: str, cursor: str) -> str:
    return f"{url}{'&' if '?' in url else '?'}{parameter}={quote(cursor, safe='')}"


def cursor_of(page: str, path: str) -> str | None:
    """The cursor that a page's JSON has at a dotted path; None where the listing ends."""
    found = json.loads(page)
    for key in path.split("."):
        found = found.get(key) if isinstance(found, dict) else None
    return str(found) if found not in (None, "") else None


class _Reader(DataSourceReader):
    """Options: urls (apart by white space), cursor (dotted path in a page), parameter (what the next page is asked by), pages (at most, of a listing; 0 for all), delay, timeout in seconds."""

    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.cursor, self.parameter = options.get("cursor", "data.after"), options.get("parameter", "after")
        self.pages, self.delay, self.timeout = int(options.get("pages", "0")), float(options.get("delay", "2")), float(options.get("timeout", "30"))

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Listings(u) for u in hosts.values()]

    def _page(self, url: str) -> str | None:
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers={"User-Agent": "corpusloom"}), timeout=self.timeout) as page:
                return page.read().decode(page.headers.get_content_charset() or "utf-8", "replace")
        except (OSError, ValueError):
            return None

    def read(self, partition: _Listings) -> Iterator[tuple]:
        asked = False
        for listing in partition.urls:
            at, url, seen = 0, listing, set()
            while not self.pages or at < self.pages:
                if asked:
                    time.sleep(self.delay)
                asked = True
                value = self._page(url)
                try:
                    cursor = cursor_of(value, self.cursor) if value is not None else None
                except ValueError:  # not JSON: a failed page as well
                    value = cursor = None
                yield listing, at, url, value
                if cursor is None or cursor in seen:  # a cursor that comes again would never end
                    break
                seen.add(cursor)
                at, url = at + 1, next_url(listing, self.parameter, cursor)


class PagedListing(DataSource):
    """listing, page, url, value."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "listing string, page int, url string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
