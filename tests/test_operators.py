"""Planner, evaluation, similarity, state, feeds, streams."""

import hashlib
import math
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens import schemas
from offerlens.operators import evaluation, planner, scorers, similarity
from offerlens.plans import hunt
from offerlens.sources import feeds, sinks, splits, state
from offerlens.settings import Settings
from offerlens.streaming.hunt import HuntLines, output_or_initial, start_hunt, updates

OFFERS = "product_description string, price double, url string, seq long, estimate double"


def offers(spark, *rows):
    return spark.createDataFrame([(f"d{i}", *r) for i, r in enumerate(rows)], "product_description string, price double, url string, seq long, estimate double")


def estimator(df):
    return df


def empty_memory(spark):
    return spark.createDataFrame([], schemas.STATE)


def test_planner_threshold_is_strict(spark):
    for gain, n in ((50.0, 0), (50.01, 1)):
        found = hunt.plan(offers(spark, (100.0, "a", 1, 100.0 + gain)), empty_memory(spark), estimator)
        assert found.count() == n


def test_planner_ties_go_to_the_first(spark):
    found = hunt.plan(offers(spark, (10.0, "a", 1, 100.0), (10.0, "b", 2, 100.0)), empty_memory(spark), estimator).first()
    assert found.deal.url == "a"


def test_planner_prices_only_the_chosen_five(spark):
    rows = [("x" * (10 - i), 1.0, f"u{i}", i, 100.0 + i) for i in range(8)]
    found = hunt.plan(spark.createDataFrame(rows, OFFERS), empty_memory(spark), estimator).first()
    assert found.deal.url == "u4"  # u5 to u7 have higher discounts but shorter descriptions


def test_planner_without_offers_gives_nothing(spark):
    assert hunt.plan(offers(spark, (0.0, "a", 1, 500.0), (-1.0, "b", 2, 500.0)), empty_memory(spark), estimator).count() == 0
    assert hunt.plan(spark.createDataFrame([], OFFERS), empty_memory(spark), estimator).count() == 0


def test_memory_drops_urls_and_keeps_repeats(spark):
    every = offers(spark, (1.0, "a", 1, 2.0), (1.0, "b", 2, 2.0), (1.0, "b", 3, 2.0))
    memory = spark.createDataFrame([("a",), (None,)], "url string")
    assert sorted(r.seq for r in planner.unseen(every, memory).collect()) == [2, 3]
    assert sorted(r.seq for r in planner.unseen(every, memory, most=0).collect()) == [2, 3]


def test_running_statistics(spark):
    rows = spark.createDataFrame([(i, e) for i, e in enumerate([1.0, 4.0, 2.5, 9.0], 1)], "i long, error double")
    got = evaluation.running(rows).orderBy("i").collect()
    assert [r["mean"] for r in got] == [1, 2.5, 2.5, 4.125]
    for r, ci in zip(got, [0, 2.078894, 1.385929, 2.947646]):
        assert math.isclose(r.ci, ci, abs_tol=1e-6)


def test_running_statistics_over_ranges(spark, tmp_path):
    """As running(), whatever the ranges; groups, nulls, equal rows and values far from 0."""
    rng = np.random.default_rng(8)
    rows = [(int(i) if i % 31 else None, int(rng.integers(0, 3)) or None, float(1e6 + rng.normal()) if i % 17 else None, "x") for i in range(1, 500)] + [(9, 1, 5.0, "y")] * 40
    df = spark.createDataFrame(rows, "i long, grp int, error double, part string")
    by_place = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or 0, r[2] is not None, r[2] or 0)):
        by_place.setdefault(r[1], []).append(r)
    for parts in (1, 5, 60):
        got = evaluation.running_parts(df, f"file://{tmp_path}/{parts}", ["grp"], parts).collect()
        assert len(got) == len(rows)
        for g, own in by_place.items():
            curve = sorted((r for r in got if r.grp == g), key=lambda r: r.n)
            assert [r.n for r in curve] == list(range(1, len(own) + 1)) and [r.i for r in curve] == [r[0] for r in own]
            for r in curve:
                e = [x[2] for x in own[: r.n] if x[2] is not None]
                assert (r["mean"] is None) == (not e)
                if e:
                    assert math.isclose(r["mean"], np.mean(e), rel_tol=1e-12) and math.isclose(r.ci, 1.96 * np.std(e) / math.sqrt(r.n), rel_tol=1e-6, abs_tol=1e-6)
    whole = evaluation.running_parts(df.select("i", "error"), f"file://{tmp_path}/whole")
    assert "SinglePartition" not in whole._jdf.queryExecution().executedPlan().toString()
    assert evaluation.running_parts(df.where("i < 0"), f"file://{tmp_path}/none").count() == 0


def test_report(spark):
    rows = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 330.0), (400.0, 380.0)], "truth double, guess double").withColumn("error", F.abs(F.col("truth") - F.col("guess")))
    r = evaluation.report(rows).first()
    assert (r.n, r.mean_error, r.mse, round(r.r2, 6), r.axis_max) == (4, 17.5, 375.0, 97.0, 400.0)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[7] = v[3]
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)] + [(100, None)], "id long, embedding array<float>")
    got = {}
    for sizes in ({}, {"query_rows": 2, "corpus_rows": 13}):  # broadcast, and dealt to executors in blocks and parts
        got = {}
        for r in similarity.nearest(rows, rows.where("id % 20 = 3"), k=5, **sizes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for q in (3, 23, 43):
            d = np.round(np.sqrt(((v.astype(np.float64) - v[q].astype(np.float64)) ** 2).sum(1)), 9)
            assert got[q] == sorted(range(60), key=lambda i: (d[i], i))[:5]


def test_nearest_of_few(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    assert similarity.nearest(rows, rows).count() == 4


def test_unknown_category_raises(spark):
    rows = spark.createDataFrame([("a",), ("z",)], "category string")
    with pytest.raises(Exception, match="unknown category"):
        similarity.category_colors(rows, ["a"], ["red"]).collect()
    assert similarity.category_colors(rows, ["a"], ["red"], strict=False).where("color is null").count() == 1


def test_state_append_is_idempotent_and_reset_keeps_two(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    row = lambda u: planner.as_opportunity(spark.createDataFrame([(u, 1.0, u, 3.0, 2.0)], "product_description string, price double, url string, estimate double, discount double"))
    assert state.read_state(spark, path).count() == 0
    for batch, url in ((0, "a"), (1, "b"), (1, "b"), (2, "c")):
        state.append_state(row(url), path, batch)
    assert state.read_state(spark, path).count() == 3
    state.reset_state(spark, path, path + "2")
    assert sorted(r.deal.url for r in state.read_state(spark, path + "2").collect()) == ["a", "b"]


def test_json_state(spark, tmp_path):
    assert state.read_json_state(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "m.json").write_text('[{"deal": {"product_description": "d", "price": 1.5, "url": "u"}, "estimate": 3.0, "discount": 1.5}]')
    assert state.read_json_state(spark, f"file://{tmp_path}/m.json").first().deal.price == 1.5
    (tmp_path / "bad.json").write_text('[{"deal": 7')
    with pytest.raises(Exception):
        state.read_json_state(spark, f"file://{tmp_path}/bad.json").collect()
    rows = planner.as_opportunity(spark.createDataFrame([(f"d{i}\n\"é\"", float(i), f"u{i}", 3.0, None) for i in range(50)], "product_description string, price double, url string, estimate double, discount double").repartition(4))
    for array in (True, False):
        for k, given in enumerate((rows, rows.limit(0))):
            path = f"file://{tmp_path}/{array}{k}"
            state.write_json_state(given, path, array=array)
            state.write_json_state(given, path, array=array)
            assert sorted(map(str, state.read_json_state(spark, path).collect())) == sorted(map(str, given.collect()))


def test_feed(spark, tmp_path):
    items = "".join(f"<item><title>t{i}</title><description>s{i}</description><link>http://x/{i}</link></item>" for i in range(11))
    (tmp_path / "f.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    entries = feeds.read_rss(spark, str(tmp_path / "f.xml"))
    head = feeds.feed_head(entries).withColumn("url", F.col("links")[0]["href"])
    assert head.count() == 10
    pages = feeds.fetched(head.select("title", "summary", "url"), lambda url: f'<div class="content-section">about {url[-1]} Features good\nmore</div>', delay_s=0)
    first = feeds.scraped(pages).where("url = 'http://x/3'").first()
    assert (first.title, first.details, first.features) == ("t3", "about 3 ", " good")


def test_splits(spark, tmp_path):
    item = lambda i: spark.createDataFrame([("t", "c", float(i), None, None, None, None, i)], schemas.ITEM)
    splits.write_splits(f"file://{tmp_path}/d", item(1), item(2), item(3))
    assert [d.first().id for d in splits.read_splits(spark, f"file://{tmp_path}/d")] == [1, 2, 3]


@pytest.mark.parametrize("n", [17, 18, 19])
def test_log_tail(spark, n):
    rows = spark.createDataFrame([(i, f"l{i}") for i in range(n)], "seq long, line string")
    assert sinks.log_tail(rows, "seq", "line").first().html == "<br>".join(f"l{i}" for i in range(n)[-18:])


def test_tool_loop_notifies_once():
    sent = []
    deals = [{"product_description": "a", "price": 10.0, "url": "u"}, {"product_description": "b", "price": 5.0, "url": "v"}]
    loop = hunt.ToolLoop(lambda: deals, lambda d: 20.0, sent.append)
    assert loop.plan()["deal"]["url"] == "v"
    assert loop.call(hunt.TOOLS[2], {"description": "x", "deal_price": 1.0, "estimated_true_value": 9.0, "url": "w"}) == "Notification sent ok"
    assert len(sent) == 1 and loop.call("unknown", {}) == ""
    assert hunt.ToolLoop(list, lambda d: 1.0, sent.append).plan() is None
    assert [t["function"]["name"] for t in hunt.tool_schemas()] == list(hunt.TOOLS)


def test_stream_surfaces_one_a_batch_and_survives_a_restart(spark, tmp_path):
    landed, lock = tmp_path / "landed", threading.Lock()
    schema = "product_description string, price double, url string, seq long, estimate double"
    def land(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(landed))
    sent = []
    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(landed))
        with lock:
            start_hunt(stream, f"file://{tmp_path}/state", str(tmp_path / "cp"), estimator, sent.append, once=True).awaitTermination()
    land(0, [("x", 10.0, "a", 1, 100.0), ("yy", 10.0, "b", 2, 90.0)])
    go()
    land(1, [("x", 10.0, "a", 1, 100.0), ("yy", 10.0, "b", 2, 90.0)])  # a is known by now, b comes again
    go()
    go()
    urls = [r.deal.url for r in state.read_state(spark, f"file://{tmp_path}/state").orderBy("batch_id").collect()]
    assert urls == ["a", "b"] and len(sent) == 2


def test_tool_loop_estimates_every_offer():
    deals = [{"product_description": f"d{i}", "price": 10.0, "url": f"u{i}"} for i in range(100)]
    loop = hunt.ToolLoop(lambda: deals, lambda d: 20.0 + float(d[1:]), lambda x: None)
    assert loop.plan()["deal"]["url"] == "u99" and sum(m["role"] == "tool" for m in loop.messages) == 102


def test_dispatch_beyond_the_broadcast_bound(spark, monkeypatch):
    calls, results = (spark.createDataFrame(r, s) for r, s in (([(1, "a"), (2, "z")], "i int, name string"), ([("a", "done")], "name string, content string")))
    for most in (hunt.MOST_RESULTS, 0):
        monkeypatch.setattr(hunt, "MOST_RESULTS", most)
        assert sorted((r.i, r.content) for r in hunt.dispatched(calls, results).collect()) == [(1, "done"), (2, "")]


def test_updates_end_with_the_output(spark, tmp_path):
    schema = "product_description string, price double, url string, seq long, estimate double"
    spark.createDataFrame([("x", 10.0, "a", 1, 100.0)], schema).write.parquet(str(tmp_path / "in"))
    lines, path, initial = ["begun"], f"file://{tmp_path}/state", empty_memory(spark)
    query = start_hunt(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "cp"), estimator, lines.append, once=True)
    seen = list(updates(query, lines, lambda: state.read_state(spark, path), initial))
    assert all(rows is initial for _, rows in seen[:-1])
    assert len(seen[-1][0]) == 2 and seen[-1][1].first().deal.url == "a"


def test_a_listener_tells_of_batches_and_the_end(spark, tmp_path):
    schema = "product_description string, price double, url string, seq long, estimate double"
    for k in range(2):
        spark.createDataFrame([(f"x{k}", 10.0, f"a{k}", k, 100.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lines = []
    listener = HuntLines("hunt-a", lines.append)
    spark.streams.addListener(listener)
    try:
        stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        for name in ("hunt-a", "hunt-b"):
            start_hunt(stream(), f"file://{tmp_path}/state-{name}", str(tmp_path / f"cp-{name}"), estimator, once=True, name=name).awaitTermination()
        for _ in range(100):
            if lines and lines[-1].endswith("ended"):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert lines == ["hunt-a has begun", "hunt-a has read batch 0 with 1 offers", "hunt-a has read batch 1 with 1 offers", "hunt-a has ended"]


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_numbered_rows(spark, tmp_path, parts):
    """Gaps, nulls, an id that a third of all rows have, extra columns; an empty table."""
    ids = [None, None, *([50] * 40), *range(0, 240, 3)]
    rows = spark.createDataFrame([(k, f"t{n}", 9) for n, k in enumerate(ids)], "id long, i string, part int").repartition(5)
    got = evaluation.numbered(rows, f"file://{tmp_path}/n", "id", parts=parts).orderBy("i").collect()
    assert [r.i for r in got] == list(range(1, len(ids) + 1)) and got[0].part == 9
    assert [r.id for r in got] == [None, None] + sorted(k for k in ids if k is not None)
    assert evaluation.numbered(rows.limit(0), f"file://{tmp_path}/e", "id", parts=parts).count() == 0


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("OFFERLENS_FEED_HEAD", "7")
    spark.conf.set("spark.offerlens.threshold", "12.5")
    try:
        got = Settings.of(spark)
    finally:
        spark.conf.unset("spark.offerlens.threshold")
    assert (got.model, got.threshold, got.feed_head) == ("stand-in", 12.5, 7)


def test_weights_from_a_file(spark, tmp_path):
    made = scorers.ResidualNetwork.random(inputs=64, hidden=8, layers=4)
    made.save(tmp_path / "w.npz")
    back = scorers.ResidualNetwork.load(spark, f"file://{tmp_path}/w.npz")
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert len(back.blocks) == 2 and (made(x) == back(x)).all()
    known = spark.createDataFrame([("Red ring of the ring",), (None,), ("",)], "text string")
    buckets = known.select(scorers.word_buckets(F.col("text"), 64).alias("b")).first().b
    want = sorted({int(hashlib.md5(w).hexdigest()[:8], 16) % 64 for w in (b"red", b"ring")})  # no stop words
    one = np.zeros((1, 64))
    one[0, want] = 1 / np.sqrt(len(want))
    price = scorers.network_scorer(back, "text", "estimate")(known).first().estimate
    assert buckets == want and math.isclose(price, max(0.0, math.exp(back(one)[0] * 1.0328539609909058 + 4.434937953948975) - 1), rel_tol=1e-9)


def test_generated_loads_its_model(spark):
    rows = spark.createDataFrame([("a b",), (None,), ("c",)], "p string")
    load = lambda: lambda prompts: [p.upper() for p in prompts]
    assert [r[0] for r in rows.select(scorers.generated(F.col("p"), load)).collect()] == ["A B", None, "C"]


def test_collection_and_table_notifier(spark, tmp_path):
    try:
        for _ in range(2):
            assert state.collection(spark, "offerlens_vectors", "id long, v array<float>").count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS offerlens_vectors")
    texts = spark.createDataFrame([("t",)], "text string")
    sinks.table_notifier(str(tmp_path / "alerts"))(texts, 3)
    assert spark.read.parquet(str(tmp_path / "alerts")).first()["batch_id"] == 3


def test_output_or_initial(spark):
    a, b = spark.range(0), spark.range(2)
    assert output_or_initial(a, b).count() == 2


def test_scorers(spark):
    known = spark.createDataFrame([("red ring", 10.0), ("red ring two", 12.0), ("blue pump", 200.0), ("blue pump big", 220.0)] * 5, "text string, price double")
    got = {r.text: r.estimate for r in scorers.text_regression(known, "text", "estimate", ridge=0.01)(known).collect()}
    assert got["red ring"] < 40 < got["blue pump"]
    network = scorers.network_scorer(scorers.ResidualNetwork.random(inputs=64, hidden=8, layers=4), "text", "estimate")
    assert all(r.estimate >= 0 for r in network(known).collect())
    assert network(known.limit(1)).first().estimate == network(known.limit(1)).first().estimate
    v = known.select(scorers.embedded(F.col("text")).alias("v")).first().v
    assert math.isclose(sum(x * x for x in v), 1, rel_tol=1e-5)


def test_log_handler_formats():
    import logging
    h = sinks.ListHandler()
    h.handle(logging.LogRecord("a", logging.INFO, "f", 1, "hello", None, None))
    assert h.lines[0].endswith("] hello") and h.lines[0].startswith("[")


def test_every_query_against_its_sql(spark):
    """Each registered query equals its SQL on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from offerlens import catalogue

    base = "/root/testdata/sf0.001"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for name in "part lineitem customer pages documents embeddings conversations events nation".split():
        db.execute(f"create view {name} as select * from '{base}/{name}.parquet'")
    sql = catalogue.oracle_sql()
    for name, query in catalogue.queries().items():
        df = query(spark, base)
        if name in sql:
            columns = sorted(df.columns)
            own = df.select(*columns).toArrow()  # noqa: F841  DuckDB reads it
            db.execute(f"create or replace temp table expected as {sql[name]}")
            c = ",".join(columns)
            assert db.execute("select count(*) from expected").fetchone()[0] == own.num_rows, name
            assert not db.execute(f"select {c} from expected except all select {c} from own").fetchall(), name
        else:
            assert df.count() > 0, name
