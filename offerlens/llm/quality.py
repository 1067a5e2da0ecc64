"""Operator 2, quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text's compressed size under the bad
dictionary minus that under the good one, over its length, is its evidence. Texts are compressed in independent pieces of
PIECE bytes, each with the fresh dictionary, so that a long text's own history doesn't take the dictionaries' place; a logistic curve fitted on labelled texts
that no dictionary has seen turns it into a probability, weighted so that classes count as often as they are labelled.

The fit uses a bounded sample: per class the SAMPLE_DOCS labelled documents with the smallest hash of their doc_id. If
their texts together exceed SAMPLE_BYTES, each text above a bound that makes them fit is represented by pieces of PIECE bytes,
spread evenly over it; no text is left out for the length of another. Every document is scored, from its whole text alone.

Defined cases: a null text counts as empty; an empty text has no evidence (0), so it gets the curve's value there.
Labels that are null or neither 0 nor 1, or without a document, are not used; a label that repeats counts once. Without labels of both classes the score is the share of
label 1, or 0.5 without any. Rows that repeat a doc_id are scored each; very long texts are
scored whole; ties of the sample's order go to the smaller doc_id, then to the smaller hash of the text. An empty table gives an empty result. Extra
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, read_table, slices

SAMPLE_DOCS = 4000
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 96 << 10
#: Bytes of the pieces in which texts are compressed and given to the dictionary trainer.
PIECE = 2048
LEVEL = 3
SEED = 71


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    base: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.good, self.bad = (self._compressor(x) for x in (model.good, model.bad))

    @staticmethod
    def _compressor(dictionary: bytes):
        if not dictionary:
            return None
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_dict_id=False)

    def evidence(self, text: bytes) -> float:
        """The normalised difference of compressed sizes; above 0: more like good texts."""
        if not text or not (self.good and self.bad):
            return 0.0
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return sum(len(self.bad.compress(x)) - len(self.good.compress(x)) for x in pieces) / len(text)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.model.slope * self.evidence(text) + self.model.base, -500, 500))))


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or raw text where there is too little to train on."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and base of the weighted fit, by Newton's method on a scaled x."""
    scale = max(float(np.sqrt(np.average(x * x, weights=weight))), 1e-9)
    design = np.stack([x / scale, np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - ridge * beta
        step = np.linalg.solve((design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + ridge * np.eye(2), grad)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(good: list[bytes], bad: list[bytes], weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Dictionaries from two of three texts of each class, the curve from the third. weights: how often a text of each class counts."""
    if not good or not bad:
        n = len(good) * weights[0] + len(bad) * weights[1]
        return Model(b"", b"", 0.0, float(np.log((len(good) * weights[0] + 0.5) / (n - len(good) * weights[0] + 0.5))))
    learn, test = ([t for i, t in enumerate(good) if i % 3], [t for i, t in enumerate(bad) if i % 3]), (good[::3], bad[::3])
    dictionaries = [dictionary(learn[k] or test[k]) for k in (0, 1)]
    scorer = Scorer(Model(*dictionaries, 1.0, 0.0))
    x = np.array([scorer.evidence(t) for k in (0, 1) for t in test[k]])
    y = np.array([1.0] * len(test[0]) + [0.0] * len(test[1]))
    return Model(*dictionaries, *logistic(x, y, np.where(y == 1, *weights)))


def text_bound(sizes: dict[int, int], most: int) -> int:
    """The largest bound, at least PIECE, for which texts cut off at it have `most` bytes together. sizes: texts by length."""
    left, texts = most, sum(sizes.values())
    for size in sorted(sizes):
        if size * texts > left:
            return max(PIECE, left // texts)
        left -= size * sizes[size]
        texts -= sizes[size]
    return max(PIECE, *sizes) if sizes else PIECE


def spread(text: bytes, bound: int) -> bytes:
    """The text, or pieces of it at even distances with about `bound` bytes together."""
    if len(text) <= bound:
        return text
    n = max(1, bound // PIECE)
    return b"".join(text[i * len(text) // n :][:PIECE] for i in range(n)) if n * PIECE < len(text) else text


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on labels(doc_id, quality) of docs(doc_id, text). At most 2 * max(sample_bytes, PIECE * sample_docs) bytes of text come to the driver."""
    place = F.xxhash64(F.lit(SEED), "doc_id")
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").distinct()  # a label that repeats counts once
    totals = {r.quality: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = [labels.where(F.col("quality") == q).withColumn("place", place).orderBy("place", "doc_id").limit(sample_docs) for q in (0, 1)]
    picks = materialize(picked[0].unionByName(picked[1]), "picked")  # at most 2 * sample_docs rows
    rows = docs.select("doc_id", F.xxhash64("text").alias("rid"), "text").where("text is not null")
    # rows that repeat a doc_id count as documents of their own; of a class, the first sample_docs rows are taken, each distinct text once with how often
    keys = rows.select("doc_id", "rid", F.octet_length("text").alias("size")).join(F.broadcast(picks), "doc_id").groupBy("quality", "place", "doc_id", "rid").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    keys = materialize(keys, "keys")
    chosen = []
    for q in (0, 1):
        left = sample_docs
        for r in keys.where(F.col("quality") == q).orderBy("place", "doc_id", "rid").limit(sample_docs).collect():
            if left > 0:
                chosen.append((q, r.place, r.doc_id, r.rid, min(left, r.n), r["size"]))
                left -= r.n
    sizes: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for q, *_, n, size in chosen:
        sizes[q][size] = sizes[q].get(size, 0) + n
    bounds = [text_bound(sizes[q], sample_bytes) for q in (0, 1)]
    # as an Arrow table, for which executors start no Python workers of another kind
    fields = pa.schema([("quality", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("rid", pa.int64())])
    table = docs.sparkSession.createDataFrame(pa.Table.from_pylist([dict(zip(fields.names, c)) for c in chosen], schema=fields))
    sample = rows.join(F.broadcast(table), ["doc_id", "rid"])
    schema = pa.schema([("quality", pa.int32()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("part", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                parts = [spread(t.encode(), bounds[q]) for q, t in zip(part.column(0).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(parts, pa.binary())], schema=schema)

    cuts = sample.select("quality", F.col("doc_id").cast("long").alias("doc_id"), "rid", "text").mapInArrow(cut, "quality int, doc_id long, rid long, part binary")
    found = {(r.quality, r.doc_id, r.rid): bytes(r.part) for r in cuts.groupBy("quality", "doc_id", "rid").agg(F.min("part").alias("part")).collect()}
    texts = {q: [t for k, _, i, rid, n, _ in chosen if k == q for t in [found[q, i, rid]] * n] for q in (1, 0)}
    return fit(texts[1], texts[0], tuple(totals.get(q, 0) / max(1, len(texts[q])) for q in (1, 0)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence) of each row of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in slices(batch):
                e = np.array([scorer.evidence((t or "").encode()) for t in part.column(1).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(scorer.model.slope * e + scorer.model.base, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(e)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence double")


def good_rows(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without those scored below `least`; all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch):
                yield part.filter(pa.array([scorer.score((t or "").encode()) >= least for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: the others are held out."""
    return labels.where(crc_mod("doc_id", 3) != 1)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, training_labels(read_table(spark, sf_dir, "labels")))
    held_out = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return scored(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
