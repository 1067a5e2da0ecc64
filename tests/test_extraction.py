"""Offers extracted from raw listings."""

import time

import pytest
from pyspark.sql import functions as F

from offerlens.operators import extraction


@pytest.fixture(scope="module")
def listings(spark):
    bodies = spark.range(2400).select("id", F.concat(F.lit("A lamp of oak number "), F.col("id").cast("string"), F.lit(".")).alias("body"))
    return extraction.labelled(bodies, F.col("id")).cache()


@pytest.fixture(scope="module")
def weights(listings):
    return extraction.train_on(listings.where("id div 12 % 3 != 1"))


def test_precision_and_recall_on_held_out_listings(spark, listings, weights):
    held = listings.where("id div 12 % 3 = 1")
    found = {r.id: (r.offer, r.price) for r in extraction.extracted(held.select("id", "text"), weights).collect()}
    truth = {r.id: r.price for r in held.collect() if r.price is not None}
    right = sum(found.get(i, (0, None))[1] == p for i, p in truth.items())
    assert len(truth) == 67 * 9
    assert right / len(found) >= 0.99 and right / len(truth) >= 0.99


def test_discounts_are_no_prices(weights):
    prices = lambda t: [round(o[2], 2) for o in extraction.offers(t, weights)]
    assert prices("A drill. $30 off this week.") == []
    assert prices("A drill. Reduced by $30.") == []
    assert prices("A drill. Take $100 off the usual $300 price.") == [200.0]
    assert prices("A drill. Enjoy 25% off $80.") == [60.0]
    assert prices("A drill. Was $1,299.50, now $999.50.") == [999.5]
    assert prices("A drill. Price: $50 plus $5.99 shipping.") == [50.0]


def test_a_text_with_several_offers(weights):
    text = "A drill with a case.\nNow only $40.\n\nNo price here.\n\nA saw. It is sharp. Was $90, now $70."
    assert [(o[0], o[1], o[2]) for o in extraction.offers(text, weights)] == [(0, "A drill with a case.", 40.0), (1, "A saw. It is sharp.", 70.0)]


def test_defined_cases(spark, weights):
    assert not any(list(extraction.offers(t, weights)) for t in (None, "", "   ", "no amounts", "$", "now only $0.00", "$$$ %%%"))
    rows = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "Now only $5.", "y"), (3, "Now only $5.", "y")], "id int, text string, note string")
    assert [(r.id, r.price, r.note) for r in extraction.extracted(rows, weights).collect()] == [(3, 5.0, "y")] * 2
    assert extraction.extracted(rows.limit(0), weights).collect() == []
    assert extraction.train_on(rows.select("text", F.lit(None).cast("double").alias("price")).limit(0)).any() == False  # noqa: E712


def test_candidates_by_hand():
    assert sorted(v for v, _ in extraction.candidates("Was $90, save $20 or 10%")) == [20 * 0.9, 20.0, 70.0, 81.0, 90.0]


def test_time_is_in_proportion(weights):
    def took(n):
        begun = time.perf_counter()
        list(extraction.offers("was $90, now $70 and more words " * n, weights))
        return time.perf_counter() - begun

    took(100)
    assert took(8000) < 20 * max(took(800), 0.02)


def test_most_detailed_first(spark, weights):
    rows = spark.createDataFrame([(1, "A lamp. Now only $5."), (2, "A lamp of oak and brass. Now only $5."), (3, "A lamp of oak and brass. Now only $7.")], "id int, text string")
    assert [r.id for r in extraction.selected(extraction.extracted(rows, weights), 2, "id").collect()] == [2, 3]


def test_amounts_are_no_parts_of_other_numbers(weights):
    """Telephone numbers, addresses and rows of signs in a text beside its price."""
    prices = lambda t: [round(o[2], 2) for o in extraction.offers(t, weights)]
    noise = "thor$$$ 170.116.163.254### a%%% call +1 (064) 555-0569%%% or 126.57.31.34%%%"
    assert extraction.candidates(noise) == []
    assert prices(f"{noise}\nNow only $513.00.") == [513.0]
    assert prices(f"{noise}\nTake $40.00 off the usual $300.00 price.") == [260.0]
    assert prices(f"{noise}\nSave $40.00 today.") == []


def test_long_texts_between_amounts_have_the_same_contexts():
    """Only words that a context reaches are read; the features are those of a text that has no others."""
    far = " ".join(f"word{'x' * (i % 90)}" for i in range(5000))
    given = extraction.candidates(f"a b c {far} now only $40, was {far} it is $50 {far}")
    tokens = extraction._tokens(f"a b c {far} now only $40, was {far} it is $50 {far}")
    assert len(tokens) < 30 and [v for v, _ in given if v in (40, 50)] == [40.0, 50.0]
    features = next(f for v, f in given if v == 40 and f[0] == "bias")
    assert "own b1:only" in features and "own b2:now" in features and "own a1:was" in features


def test_learns_from_every_listing(spark):
    """One listing in ten thousand has wording of its own; a sample would not know it. Tasks give what one process gives."""
    rows = spark.range(10_000).select(F.when(F.col("id") == 7, "A drill. Surrender $40.00 heartily.").otherwise(F.concat(F.lit("A lamp "), F.col("id").cast("string"), F.lit(". Now only $5.00."))).alias("text"), F.when(F.col("id") == 7, 40.0).otherwise(5.0).alias("price"))
    whole = extraction.fit([(r.text, r.price) for r in rows.collect()])
    known = extraction._hashed(["own b1:surrender", "own a1:heartily"])
    for held in (extraction.HELD, 1):
        weights = extraction.train_on(rows, held=held)
        assert (weights == whole).all() and (weights[known] > 0).all()


def test_the_query_learns_from_all_its_listings(spark, monkeypatch):
    import os

    from offerlens import catalogue

    base = "/root/testdata/sf0.001"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    seen, own = [], extraction.train_on
    monkeypatch.setattr(extraction, "train_on", lambda listings, *a, **b: (seen.append((listings.count(), a, b)), own(listings, *a, **b))[1])
    catalogue.listing_offers(spark, base)
    assert seen == [(catalogue.listings(spark, base).count(), (), {})]
