"""The store of surfaced opportunities: JSON for exchange, an append-only table for runs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import OPPORTUNITY, STATE

#: Rows of one file of a JSON array, about; one task writes it, and one reads it.
FILE_ROWS = 50_000
#: Rows that a reset keeps.
RESET_ROWS = 2


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_json_state(spark: SparkSession, path: str) -> DataFrame:
    """Opportunities of a JSON array, however it is indented, or of a row a line; none if there is no file. A malformed row raises."""
    if not exists(spark, path):
        return spark.createDataFrame([], OPPORTUNITY)
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0].value.lstrip().startswith("[")
    return spark.read.schema(OPPORTUNITY).option("multiLine", array).option("mode", "FAILFAST").json(path)


def write_json_state(state: DataFrame, path: str, array: bool = False, file_rows: int = FILE_ROWS) -> None:
    """Overwrites a JSON state: a row a line, by all tasks; or indented arrays for exchange: one file up to file_rows rows, beyond it several, each an array of its
    own, as a reader takes an array whole."""
    rows = state.select(*OPPORTUNITY.fieldNames())
    if not array:
        rows.write.mode("overwrite").json(path)
        return

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sep = "["
        for batch in batches:
            out = []
            for row in batch["value"]:
                body = json.dumps(json.loads(row), indent=2, ensure_ascii=False).replace("\n", "\n  ")
                out.append(f"{sep}\n  {body}")
                sep = ","
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["]" if sep == "," else "[]"]})

    text = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    files = -(-text.count() // file_rows)
    text = text.repartition(files) if files > 1 else text.coalesce(1)  # evenly, however often a row repeats
    text.mapInPandas(lines, "value string").write.mode("overwrite").text(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The append-only table; none if it is missing. batch_id is its partition column."""
    if not exists(spark, path):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(path)


def append_state(rows: DataFrame, path: str, batch_id: int) -> None:
    """Writes a run's rows under its batch_id. A repeated run replaces its own rows, so a retry adds nothing."""
    rows.withColumn("seq", F.lit(batch_id).cast("long")).drop("batch_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def reset_state(spark: SparkSession, path: str, to: str, keep: int = RESET_ROWS) -> None:
    """Writes the first rows in order of surfacing to a new place; nothing is written over what is being read."""
    rows = read_state(spark, path).orderBy("seq", F.to_json("deal")).limit(keep)
    rows.write.mode("overwrite").partitionBy("batch_id").parquet(to)


def collection(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A table of vectors, created where it is missing."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    return spark.table(name)
