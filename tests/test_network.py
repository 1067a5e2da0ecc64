"""Hashed words against published values; the network's gradient against differences; training against simpler models."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlens.functions import hashing
from offerlens.operators import scorers, training


def test_murmur_equals_published_values():
    spans = lambda b: (np.frombuffer(b, np.uint8), np.zeros(1, np.int64), np.array([len(b)]))
    known = [(b"", 0, 0), (b"", 1, 0x514E28B7), (b"", 0xFFFFFFFF, 0x81F16F39), (b"\xff\xff\xff\xff", 0, 0x76293B50), (b"\x21\x43\x65\x87", 0, 0xF55B516B), (b"\x21\x43\x65\x87", 0x5082EDEE, 0x2362F9DE),
             (b"\x21\x43\x65", 0, 0x7E4A8634), (b"\x21\x43", 0, 0xA0F7B07A), (b"\x21", 0, 0x72661CF4), (b"\0\0\0\0", 0, 0x2362F9DE), (b"aaaa", 0x9747B28C, 0x5A97808A), (b"Hello, world!", 0x9747B28C, 0x24884CBA),
             ("ππππππππ".encode(), 0x9747B28C, 0xD58063C1), (b"The quick brown fox jumps over the lazy dog", 0x9747B28C, 0x2FA826CD), (b"a" * 256, 0x9747B28C, 0x37405BDC)]
    for data, seed, want in known:
        assert int(hashing.murmur3(*spans(data), seed).view(np.uint32)[0]) == want, data
    words = ["a" * n for n in range(0, 700, 7)] + ["ππππππππ", "x"]
    got = hashing.hashes(pa.array(words), 5)
    assert got.tolist() == [int(hashing.murmur3(*spans(w.encode()), 5)[0]) for w in words]


def test_murmur_buckets_of_rows(spark):
    rows = [(["apple", "banana", "apple"],), ([],), (None,), ([None, "é"],)]
    got = [r.b for r in spark.createDataFrame(rows, "w array<string>").coalesce(1).select(hashing.murmur_buckets(F.col("w"), 50).alias("b")).collect()]
    bucket = lambda w: abs(int(hashing.hashes(pa.array([w]))[0])) % 50
    assert got == [sorted({bucket("apple"), bucket("banana")}), [], [], [bucket("é")]]


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    network = scorers.ResidualNetwork.random(inputs=12, hidden=5, layers=4, seed=3)
    sizes = np.array([3, 0, 2, 4])
    buckets = np.concatenate([rng.choice(12, n, replace=False) for n in sizes])
    labels, weights = rng.normal(size=4), np.array([1.0, 2.0, 1.0, 3.0])
    flat = np.concatenate([m.ravel() for m in training.arrays(network)]) + rng.normal(0, 0.1, sum(m.size for m in training.arrays(network)))
    value = lambda f: training.gradient(training.with_arrays(network, f), sizes, buckets, labels, weights)[0]
    slope = np.concatenate([m.ravel() for m in training.gradient(training.with_arrays(network, flat), sizes, buckets, labels, weights)[1]])
    for i in range(len(flat)):
        d = np.zeros_like(flat)
        d[i] = 1e-6
        assert abs((value(flat + d) - value(flat - d)) / 2e-6 - slope[i]) < 1e-5 * max(1, abs(slope[i]))
    x = np.zeros((4, 12))
    for r, (n, at) in enumerate(zip(sizes, np.cumsum(sizes) - sizes)):
        x[r, buckets[at : at + n]] = 1 / np.sqrt(max(n, 1))
    assert np.isclose(value(flat), (weights * (training.with_arrays(network, flat)(x) - labels) ** 2).sum() / 2)


@pytest.fixture(scope="module")
def listings(spark):
    """Prices that depend on pairs of words: cheap and dear words are worth the opposite in bundles."""
    rng = random.Random(6)
    rows = []
    for i in range(900):
        dear, bundle = rng.random() < 0.5, rng.random() < 0.5
        words = ["premium" if dear else "basic", "bundle" if bundle else "single", *rng.sample(["red", "blue", "tall", "flat", "kit", "box", "max"], 2)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), (200.0 if dear != bundle else 50.0) * (1 + 0.05 * rng.random()), i % 3 == 1))
    rows += [(900, "premium single", None, False), (901, None, 60.0, False), (902, "", 60.0, False)]
    return spark.createDataFrame(rows, "id long, text string, price double, held_out boolean").repartition(4)


def test_trained_network_beats_mean_and_linear_model(spark, listings, tmp_path):
    known = listings.where("not held_out")
    buckets = lambda t, n=512: scorers.murmur_word_buckets(t, n)
    begun = scorers.ResidualNetwork.random(inputs=512, hidden=16, layers=4)
    how = {"steps": 50, "rate": 0.02}
    network, losses = training.trained(known, buckets(F.col("text")), begun, f"file://{tmp_path}/a", **how)
    again, _ = training.trained(known.repartition(7), buckets(F.col("text")), begun, f"file://{tmp_path}/b", **how)
    assert all((a == b).all() for a, b in zip(training.arrays(network), training.arrays(again)))
    assert losses[-1] < 0.2 * losses[0]
    both = scorers.text_regression(known, "text", "linear")(scorers.network_scorer(network, "text", "estimate", buckets)(listings.where("text is not null")))
    rows = both.where("held_out").collect()
    mean = np.mean([r.price for r in known.where("price is not null").collect()])
    error = lambda f: np.mean([abs(f(r) - r.price) for r in rows])
    assert error(lambda r: r.estimate) < 0.3 * min(error(lambda r: mean), error(lambda r: r.linear))


def test_blocks_dropout_and_no_rows(spark, listings, tmp_path):
    begun = scorers.ResidualNetwork.random(inputs=32, hidden=4, layers=2)
    buckets = scorers.murmur_word_buckets(F.col("text"), 32)
    chunks, blocks = training.packed(listings, buckets, f"file://{tmp_path}/c", chunk_rows=50, step_rows=200)
    assert blocks > 1 and chunks.select("block").distinct().count() == blocks
    assert chunks.agg(F.sum(F.aggregate("weights", F.lit(0.0), lambda a, b: a + b))).first()[0] == 902
    network, losses = training.trained(listings, buckets, begun, f"file://{tmp_path}/d", steps=6, dropout=0.2, chunk_rows=50, step_rows=200)
    assert len(losses) == 6 and np.isfinite(losses).all()
    same, none = training.trained(listings.where("price is null"), buckets, begun, f"file://{tmp_path}/e")
    assert none == [] and same is begun
    with pytest.raises(ValueError):
        training.trained(listings, buckets, scorers.ResidualNetwork.random(inputs=5000, hidden=900, layers=2), f"file://{tmp_path}/f")


def test_a_network_scores_a_bounded_number_of_texts_at_once():
    import numpy as np
    import pandas as pd

    from offerlens.operators import scorers

    network, sizes = scorers.ResidualNetwork.random(inputs=64, hidden=4, layers=3), []

    class Watched(scorers.ResidualNetwork):
        def __call__(self, x):
            sizes.append(len(x))
            return super().__call__(x)

    ids = pd.Series([None, [], *([i % 64, (i * 7 + 1) % 64] for i in range(2998))])
    found = scorers.scored(Watched(network.first, network.blocks, network.last), ids)
    dense = np.zeros((3000, 64))
    for i, at in enumerate(ids):
        dense[i, at or []] = 1 / np.sqrt(len(at or [1]))
    assert max(sizes) <= 256 and np.allclose(found, network(dense)) and len(scorers.scored(network, ids[:0])) == 0
