"""The screen for a very large memory."""

from pyspark.sql import functions as F

from offerlens.operators import planner, screen


def keys(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))


def found(df):
    return sorted((r.url or "", r.x) for r in df.collect())


def test_equals_the_join_and_bounds_what_is_shuffled(spark, tmp_path):
    memory = keys(spark, 0, 20_000).unionAll(keys(spark, 0, 500))
    offers = keys(spark, 15_000, 60_000).withColumn("x", F.lit(1))
    own = screen.build(memory, f"file://{tmp_path}/s")
    assert found(screen.unseen(offers, memory, own)) == found(planner.unseen(offers, memory))
    passed = screen.marked(offers, own).where("possible").select(F.substring("url", 2, 9).cast("long").alias("i"))
    assert passed.where("i < 20000").count() == 5_000  # no key of the memory is missed
    wrong = passed.where("i >= 20000").count() / 40_000
    assert wrong < 0.03 and abs(wrong - screen.passing(own.keys, own.n)) < 0.01


def test_defined_cases(spark, tmp_path):
    offers = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", 3), ("", 4)], "url string, x int")
    memory = spark.createDataFrame([("b",), (None,), ("b",)], "url string")
    own = screen.build(memory, f"file://{tmp_path}/s")
    for most in (screen.MOST_BLOCKS, 0):
        assert found(screen.unseen(offers, memory, own, most_blocks=most)) == [("", 2), ("", 4), ("a", 1), ("a", 1)]
    none = screen.build(memory.limit(0), f"file://{tmp_path}/e")
    assert found(screen.unseen(offers, memory.limit(0), none)) == found(offers)
    assert screen.unseen(offers.limit(0), memory, own).count() == 0


def test_offers_are_not_shuffled_to_be_marked(spark, tmp_path):
    offers, own = keys(spark, 0, 100), screen.build(keys(spark, 0, 10), f"file://{tmp_path}/s")
    plan = screen.marked(offers, own)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_expected_share_by_hand():
    assert screen.passing(0, 5) == 0.0
    assert 0.003 < screen.passing(42_000, 1000) < 0.03
