"""The inverted index against exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.operators import similarity, vector_index

SCHEMA = "id long, embedding array<float>, list int, ids string"


def vectors(spark, n=3000, width=10, copies=400, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, width)) * 3
    x = (centres[rng.integers(0, 30, n)] + rng.normal(size=(n, width))).astype(np.float32)
    x[n - copies :] = x[5]  # a vector with many copies
    rows = [(i, [float(v) for v in x[i]], 1, "") for i in rng.permutation(n)]
    odd = [(n + 1, None, 1, ""), (None, [0.0] * width, 1, ""), (n + 2, [float("nan")] * width, 1, ""), (n + 3, [None] * width, 1, ""), (n + 4, [1.0], 1, "")]
    return spark.createDataFrame([(int(i) if i is not None else None, *r) for i, *r in rows + odd], SCHEMA).repartition(5)


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance, r["rank"]))
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    corpus = vectors(spark)
    path = f"file://{tmp_path_factory.mktemp('index')}"
    model = vector_index.train(corpus, path, parts=4)
    return corpus, vector_index.build(corpus, model, path), path


def test_all_lists_and_a_full_short_list_are_exact(spark, made):
    corpus, index, _ = made
    queries = corpus.where("id % 20 = 0")
    want = answers(similarity.nearest(corpus.where("size(embedding) = 10 and not isnan(embedding[0]) and embedding[0] is not null"), queries, 5))
    assert len(want) == 150
    assert answers(vector_index.search(index, queries, 5, probes=10_000, short=10_000)) == want
    assert answers(vector_index.search(index, queries, 5, probes=10_000, short=10_000, block_rows=50, query_rows=7)) == want


def test_every_row_is_indexed(spark, made):
    corpus, index, _ = made
    ids = {i for r in spark.read.parquet(f"{index.path}/lists").collect() for i in r.ids}
    n = 3000
    assert ids >= set(range(n - 400)) and len(ids) == n - 401 + index.copies  # of 401 equal vectors, the smallest ids
    with pytest.raises(ValueError):
        vector_index.search(index, corpus, k=index.copies + 1)


def test_calibrated_recall_and_reopening(spark, made):
    corpus, index, path = made
    index = vector_index.calibrated(index, corpus, target=0.97, trials=200)
    assert 1 <= index.model.probes < len(index.model.centres) / 2
    queries = corpus.where("id % 20 = 0")
    exact = similarity.nearest(corpus.where("id < 3000"), queries, 5)
    again = vector_index.open_index(spark, path)
    assert again.model.probes == index.model.probes and (again.model.books == index.model.books).all()
    found = vector_index.search(again, queries, 5)
    row = vector_index.recall(found, exact).first()
    assert row.queries == 150 and row.recall >= 0.9
    assert answers(found) == answers(vector_index.search(index, queries, 5))


def test_appending_and_copies_across_batches(spark, tmp_path):
    corpus = vectors(spark, 600, 6, 50)
    path = f"file://{tmp_path}"
    model = vector_index.train(corpus, path, lists=9, parts=2)
    vector_index.build(corpus.where("id % 2 = 0"), model, path)
    index = vector_index.build(corpus.where("id % 2 = 1"), model, path, mode="append")
    queries = corpus.where("id % 20 = 1 or id = 5")
    want = answers(similarity.nearest(corpus.where("size(embedding) = 6 and id < 600"), queries, 5))
    assert answers(vector_index.search(index, queries, 5, probes=9, short=600)) == want


def test_empty_and_tiny(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert vector_index.train(none, f"file://{tmp_path}/a") is None
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0, "")], SCHEMA)
    index = vector_index.build(one, vector_index.train(one, f"file://{tmp_path}/b"), f"file://{tmp_path}/b")
    assert [(r.query_id, r.id, r.distance) for r in vector_index.search(index, one).collect()] == [(1, 1, 0.0)]
    assert vector_index.search(index, none).count() == 0
    assert vector_index.recall(none.select(F.col("id").alias("query_id"), F.lit(0.0).alias("distance")), none.select(F.col("id").alias("query_id"), F.lit(0.0).alias("distance"))).first().queries == 0


def test_the_sample_is_fitted_by_many_tasks(spark, made):
    """A limit leaves one part: k-means went through one task. A rerun gives the same centres."""
    corpus, index, path = made
    files = spark.read.parquet(f"{path}/sample").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1
    again = vector_index.train(corpus.repartition(3, "id"), f"{path}/again", parts=4)
    assert np.array_equal(again.centres, index.model.centres) and np.array_equal(again.books, index.model.books)
