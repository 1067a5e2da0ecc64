"""Per-row Python is dealt over tasks, by batches, even where a table is one file of one row group."""

import os

import pytest
from pyspark.sql import functions as F

from offerlens import catalogue
from offerlens.operators import extraction

BASE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
def test_summaries_are_extracted_by_many_tasks(spark):
    assert catalogue.table(spark, BASE, "part").rdd.getNumPartitions() == 1
    assert catalogue.extract_summary(spark, BASE).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_offers_go_through_python_by_batches(spark):
    rows = spark.createDataFrame([(1, "A lamp. Now only $5.")], "id int, text string")
    found = extraction.extracted(rows, extraction.fit([("A lamp. Now only $5.", 5.0)]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "UDTF" not in plan
    assert found.collect()[0].price == 5.0


def test_the_sample_is_that_of_the_smallest_hashes(spark):
    rows = spark.range(3000).select(F.concat(F.lit("A lamp "), F.col("id").cast("string"), F.lit(". Now only $5.")).alias("text"), F.lit(5.0).alias("price"))
    first = rows.orderBy(F.xxhash64("text"), "text").limit(100).collect()
    assert (extraction.train_on(rows, most=100) == extraction.fit([(r.text, r.price) for r in first])).all()


def test_distances_are_taken_by_tiles():
    """The matrix of distances of a batch is never whole: its memory would grow with the queries."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from offerlens.operators import similarity

    rng = np.random.default_rng(0)

    def batch(n, at):
        v = rng.integers(-3, 4, (n, 8)).astype(np.float32)
        return v, pa.RecordBatch.from_arrays([pa.array(np.arange(n) + at), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 8), pa.array(v.ravel()))], names=["id", "embedding"])

    (q, asked), (x, given) = batch(700, 0), batch(9000, 100)
    tracemalloc.start()
    found = [r for b in similarity._best(asked, given, 5, 9) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # the whole matrix has 50 MB, its copies 150
    distance = np.round(np.sqrt(((q[:, None].astype(float) - x[None]) ** 2).sum(2)), 9)
    wanted = {(i, int(j) + 100) for i in range(700) for j in np.lexsort((np.arange(9000), distance[i]))[:5]}
    assert {(r["query_id"], r["id"]) for r in found} == wanted and len(found) == 3500


def test_a_large_array_of_states_is_several_files(spark, tmp_path):
    """A JSON array is read whole by one task, so a file has a bounded number of rows; a small state stays one array."""
    import glob
    import json

    from offerlens.sources import state

    rows = catalogue.opportunity_rows(spark, BASE).cache()
    for file_rows, least in ((1000, 1), (20, 5)):
        path = f"{tmp_path}/{file_rows}"
        state.write_json_state(rows, f"file://{path}", array=True, file_rows=file_rows)
        files = glob.glob(f"{path}/part-*")
        sizes = [len(json.load(open(f))) for f in files]
        assert (len(files) == 1 if least == 1 else len(files) >= least) and sum(sizes) == 200 and max(sizes) <= 2 * file_rows
        assert sorted(map(str, state.read_json_state(spark, f"file://{path}").collect())) == sorted(map(str, rows.collect()))
