"""Item datasets in three splits, partitioned by split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ITEM

SPLITS = ("train", "validation", "test")


def write_splits(path: str, train: DataFrame, validation: DataFrame, test: DataFrame) -> None:
    rows = [d.select(*ITEM.fieldNames()).withColumn("split", F.lit(s)) for s, d in zip(SPLITS, (train, validation, test))]
    rows[0].unionByName(rows[1]).unionByName(rows[2]).write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each reads its own partition only."""
    rows = spark.read.schema(T.StructType([*ITEM.fields, T.StructField("split", T.StringType())])).parquet(path)
    train, validation, test = (rows.where(F.col("split") == s).drop("split") for s in SPLITS)
    return train, validation, test
