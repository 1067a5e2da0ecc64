"""The corpus pipeline over documents: reject bad texts, drop exact and near copies, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before has kept; its result is written as
Parquet and read again as the next one's docs. All stages but the last return the columns of documents.

Rows with null texts, repeated rows and extra columns pass as the operators define it: a null text counts as empty, of
equal texts one row stays, rows with a null doc_id are never near copies. Very long texts pass whole; the mix takes a document 0 to 3 times as a whole.
Ties: a score of 0.5 is kept; of equal texts the largest doc_id stays, of near copies the smallest; equal quotients go to the source
that comes first, then to the smaller shard. An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerlens.llm import byte_bpe, exact_dedup, near_dedup, quality, source_mix
from offerlens.llm.common import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below 0.5. It learns from the labels that are not held out."""
    model = quality.train(docs, quality.training_labels(read_table(spark, sf_dir, "labels")))
    return quality.good_rows(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the row with the largest doc_id."""
    return exact_dedup.dedup_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), keeps the document with the smallest doc_id."""
    return near_dedup.near_dedup_rows(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources has it, 0 to 3 times."""
    return source_mix.mixed_rows(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their digest and that of what they decode to."""
    return byte_bpe.encoded(docs, *byte_bpe.default_vocabulary())


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("source_mix", mix_stage), ("byte_bpe", encode_stage)]
#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
