"""Feeds and pages: landed XML files, live fetching through a pluggable client, canned offers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.html import page_text, snippet_text
from ..schemas import FEED_ENTRY, OFFER

#: Entries taken from each feed.
FEED_HEAD = 10
DELAY_S = 0.05


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Entries (title, summary, links, feed, pos) of landed RSS files; a file is a feed, pos its entries' order."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title STRING, description STRING, link STRING").load(path)
    at = items.select(F.col("title"), F.col("description").alias("summary"), F.array(F.struct(F.col("link").alias("href"))).alias("links"), F.col("_metadata.file_path").alias("feed"), F.monotonically_increasing_id().alias("pos"))
    return at.select(*FEED_ENTRY.fieldNames(), "feed", "pos")


def feed_head(entries: DataFrame, feed: str = "feed", pos: str = "pos", n: int = FEED_HEAD) -> DataFrame:
    """The first n entries of each feed, in feed order."""
    return entries.withColumn("place", F.row_number().over(Window.partitionBy(feed).orderBy(pos)).cast("long")).where(F.col("place") <= n)


def fetched(entries: DataFrame, fetch: Callable[[str], str], delay_s: float = DELAY_S) -> DataFrame:
    """entries(url, ...) with html from a client function, politely, one connection a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages = []
            for url in pdf["url"]:
                pages.append(fetch(url))
                time.sleep(delay_s)
            yield pdf.assign(html=pages)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInPandas(run, f"{fields}, html string")


def scraped(entries: DataFrame, html: str = "html", tag: str = "div", name: str | None = "content-section") -> DataFrame:
    """entries(title, summary, url, html) as offers to read: title, summary, url, details, features, cut to their limits."""
    content = page_text(F.col(html), tag, name)
    with_content = entries.withColumn("__content", content)
    return with_content.select(
        F.lit(None).cast("string").alias("category"), text.cut(F.col("title"), text.LIMITS["title"]).alias("title"), snippet_text(F.col("summary")).alias("summary"), "url",
        text.cut(text.before_marker(F.col("__content")), text.LIMITS["details"]).alias("details"), text.cut(text.behind_marker(F.col("__content")), text.LIMITS["features"]).alias("features"),
    )


def canned_offers(spark: SparkSession) -> DataFrame:
    """Four offers for trials, with seq. Only the prices matter."""
    rows = [(f"Trial offer {i} with a description of its own", float(p), f"https://offers.example/{i}", i) for i, p in enumerate((178, 30, 446, 650), 1)]
    return spark.createDataFrame(rows, "product_description string, price double, url string, seq long").select(*OFFER.fieldNames(), "seq")
