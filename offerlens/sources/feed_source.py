"""RSS feeds as a data source of Spark, for batches and streams: spark.read.format("offer_feed"), spark.readStream.format("offer_feed").

    spark.dataSource.register(FeedSource)
    spark.readStream.format("offer_feed").option("feeds", json.dumps([url, ...])).option("per_feed", 10).load()

Rows are (feed, pos, title, summary, link); pos counts a feed's entries from its oldest, so (feed, pos) names an entry for as long as its feed keeps growing at its new end.
A feed is a task. Options: feeds, a JSON list of addresses; newest_first (default true, as feeds have it; false for landed files that grow at their end);
per_feed, how many entries of a feed a micro-batch takes at most (default 10) or, in a batch, how many of its newest (default: all); delay seconds before each
request (0.05), retries of a failed one with doubled pauses (2); client, "module:function" of a function from an address to its text.

A stream's offset is the number of entries read of each feed, kept in the stream's checkpoint: a restart reads on from there, and a repeated micro-batch reads the same entries.
A feed that can't be reached in a stream stays where it is until the next micro-batch; in a batch, or while a planned micro-batch is read, it raises. So does a feed
that has fewer entries than were read of it: entries would be lost in silence. Missing elements are null; an empty feed has no rows; a feed that is listed twice is read once.
"""

from __future__ import annotations

import json
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "feed string, pos long, title string, summary string, link string"


def landed(address: str) -> str:
    """The text at an address: http(s), or a file of any file system that Arrow knows."""
    if address.startswith(("http://", "https://")):
        from urllib.request import urlopen

        with urlopen(address, timeout=30) as answer:  # noqa: S310  http and https only
            return answer.read().decode("utf-8", "replace")
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(address if ":" in address else f"file://{address}")
    with files.open_input_stream(path) as body:
        return body.read().decode("utf-8", "replace")


def entries(text: str, newest_first: bool) -> list[tuple[str | None, str | None, str | None]]:
    """(title, summary, link) of each item, oldest first."""
    items = [tuple(item.findtext(tag) for tag in ("title", "description", "link")) for item in ET.fromstring(text).iter("item")]
    return items[::-1] if newest_first else items


class Settings:
    def __init__(self, options: dict):
        self.feeds = list(dict.fromkeys(json.loads(options.get("feeds", "[]"))))
        self.newest_first = str(options.get("newest_first", "true")).lower() != "false"
        self.per_feed = int(options["per_feed"]) if "per_feed" in options else None
        self.delay, self.retries = float(options.get("delay", 0.05)), int(options.get("retries", 2))
        self.client = options.get("client", f"{__name__}:landed")

    def read(self, feed: str) -> list[tuple[str | None, str | None, str | None]]:
        """A feed's entries, politely and with retries."""
        module, name = self.client.split(":")
        fetch: Callable[[str], str] = getattr(import_module(module), name)
        for attempt in range(self.retries + 1):
            time.sleep(self.delay * 2**attempt)
            try:
                return entries(fetch(feed), self.newest_first)
            except Exception:
                if attempt == self.retries:
                    raise
        raise AssertionError


class Range(InputPartition):
    """Entries begin to end (or the newest `newest`) of a feed."""

    def __init__(self, feed: str, begin: int = 0, end: int | None = None, newest: int | None = None):
        super().__init__(feed)
        self.feed, self.begin, self.end, self.newest = feed, begin, end, newest


def _rows(settings: Settings, part: Range) -> Iterator[tuple]:
    found = settings.read(part.feed)
    end = len(found) if part.end is None else part.end
    if len(found) < end:
        raise ValueError(f"{part.feed} has {len(found)} entries, {end} were there before")
    begin = part.begin if part.newest is None else max(0, end - part.newest)
    for pos in range(begin, end):
        yield (part.feed, pos, *found[pos])


class BatchReader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def partitions(self) -> list[Range]:
        return [Range(f, newest=self.settings.per_feed) for f in self.settings.feeds] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.settings, partition) if partition.feed else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, settings: Settings):
        self.settings = settings
        self.read_to: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """At most per_feed entries behind what the last planned micro-batch read. On a restart, Spark plans its last micro-batch again before it asks."""
        out = dict(self.read_to)
        for feed in self.settings.feeds:
            at = out.get(feed, 0)
            try:
                there = len(self.settings.read(feed))
            except Exception:  # noqa: BLE001  out of reach for now: nothing is lost, the offset stays
                continue
            if there > at:
                out[feed] = min(there, at + (self.settings.per_feed or 10))
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.read_to = dict(end)
        return [Range(feed, start.get(feed, 0), to) for feed, to in sorted(end.items()) if to > start.get(feed, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.settings, partition)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "offer_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(Settings(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Settings(self.options))
