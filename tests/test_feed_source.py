"""Feeds as a data source: batches, streams with restarts, retries and limits."""

import json
import os

import pytest

from offerlens.sources import feed_source

ITEM = "<item><title>t{0}</title><description>d &amp; {0}</description><link>http://x/{0}</link></item>"


def write(path, ids, newest_first=True):
    ids = list(ids)
    body = "".join(ITEM.format(i) for i in (ids[::-1] if newest_first else ids))
    path.write_text(f"<?xml version='1.0'?><rss><channel><title>c</title>{body}</channel></rss>")
    return f"file://{path}"


@pytest.fixture
def source(spark):
    spark.dataSource.register(feed_source.FeedSource)
    return lambda reader, feeds, **o: reader.format("offer_feed").options(feeds=json.dumps(feeds), delay="0", **o).load()


def test_batch_positions_count_from_the_oldest(spark, source, tmp_path):
    a, b, none = write(tmp_path / "a.xml", range(5)), write(tmp_path / "b.xml", range(20, 23), newest_first=False), write(tmp_path / "c.xml", [])
    got = [tuple(r) for r in source(spark.read, [a, none, a]).orderBy("pos").collect()]
    assert got == [(a, i, f"t{i}", f"d & {i}", f"http://x/{i}") for i in range(5)]
    assert [r.pos for r in source(spark.read, [a], per_feed="2").orderBy("pos").collect()] == [3, 4]
    assert [r.title for r in source(spark.read, [b], newest_first="false").orderBy("pos").collect()] == ["t20", "t21", "t22"]
    assert source(spark.read, []).count() == 0
    with pytest.raises(Exception, match="gone"):
        source(spark.read, [f"file://{tmp_path}/gone.xml"], retries="0").collect()


def run(source, spark, feeds, where, **o):
    stream = source(spark.readStream, feeds, **o)
    query = stream.writeStream.format("parquet").option("path", f"file://{where}/out").option("checkpointLocation", f"file://{where}/at").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def test_stream_restarts_lose_and_repeat_nothing(spark, source, tmp_path):
    a, b = write(tmp_path / "a.xml", range(7)), write(tmp_path / "b.xml", range(100, 103))
    gone = f"file://{tmp_path}/late.xml"
    run(source, spark, [a, b, gone], tmp_path, per_feed="3", retries="0")
    out = lambda: sorted((os.path.basename(r.feed), r.pos, r.title) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    want = [("a.xml", i, f"t{i}") for i in range(7)] + [("b.xml", i, f"t{100 + i}") for i in range(3)]
    assert out() == want
    run(source, spark, [a, b, gone], tmp_path, per_feed="3", retries="0")
    assert out() == want
    write(tmp_path / "a.xml", range(12))
    write(tmp_path / "late.xml", range(50, 52))
    run(source, spark, [a, b, gone], tmp_path, per_feed="3", retries="0")
    want = [("a.xml", i, f"t{i}") for i in range(12)] + [("b.xml", i, f"t{100 + i}") for i in range(3)] + [("late.xml", i, f"t{50 + i}") for i in range(2)]
    assert out() == want
    files = [f for f in os.listdir(tmp_path / "out") if f.startswith("part")]
    assert len(files) >= 5  # several micro-batches: at most three entries of a feed each


def test_a_feed_that_shrinks_raises_instead_of_losing():
    reader = feed_source.StreamReader(feed_source.Settings({"feeds": '["x"]', "delay": "0", "retries": "0", "client": "tests_no_such:f"}))
    assert reader.latestOffset() == {}
    settings = feed_source.Settings({"feeds": '["x"]'})
    settings.read = lambda feed: [("t", "s", "l")]
    with pytest.raises(ValueError, match="before"):
        list(feed_source._rows(settings, feed_source.Range("x", 0, 2)))


def test_retries(monkeypatch):
    calls = []

    def flaky(address):
        calls.append(address)
        if len(calls) < 3:
            raise OSError("again")
        return "<rss><item><title>a</title></item></rss>"

    monkeypatch.setattr(feed_source, "landed", flaky)
    assert feed_source.Settings({"delay": "0"}).read("f") == [("a", None, None)] and len(calls) == 3
