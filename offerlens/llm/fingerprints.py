"""Operator 3, document fingerprints: closed syncmers with positions.

A k-mer of code points is chosen if the smallest hash of its inner s-mers lies at its first or last place. The choice
depends on the k-mer alone, so an edit elsewhere changes nothing. The fingerprint keeps every closed syncmer (about
2 / (K - S + 2) of all places) as a 32-bit hash with its place, by place, so it grows with the text and a passage that long texts share is always
in it. Likeness by positional matching: equal anchors of both fingerprints, the n-th of a hash with the n-th, of which the longest chain
that keeps the order in both counts, as a share of all anchors of the two. So insertions that shift what follows cost only what they cover.

Defined cases: null counts as empty. A text without a syncmer, or shorter than k, has its whole as one anchor; an empty
text has the empty fingerprint, which is like (1) another empty one and unlike (0) any other. Equal texts have equal
fingerprints; very long texts are fingerprinted whole. Rows that repeat are fingerprinted each. An empty table gives an
empty result. Extra columns are never read.

For the next document, rows are dealt into ranges of doc_id and a hash of the text; the first row of each range is copied
to the range before. Rows with a null doc_id come last in descending order; rows of one doc_id by that hash, then by their text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read_table, slices

K, S = 24, 8
#: Documents in a range, about.
RANGE_DOCS = 2000
MOST_RANGES = 65_536
_STEP = np.uint64(0xD1342543DE82EF95)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _rolled(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _STEP + x[k : k + n]
    return mix64(out)


def syncmers(text: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each closed syncmer of a text's code points."""
    n = len(text) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = text.astype(np.uint64) + np.uint64(1)
    inner = _rolled(x, s)
    least, span, width = inner, 1, k - s + 1  # smallest of a window, by doubling
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n], least[width - span :][:n])
    at = np.flatnonzero((inner[:n] == least) | (inner[k - s : k - s + n] == least))
    with np.errstate(over="ignore"):
        h = mix64(inner[at] * np.uint64(0x9FB21C651E98DF25) + inner[at + k - s] + inner[at + (k - s) // 2] * np.uint64(0xE7037ED1A0B428DB))
    return h, at


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (uint32) of a text's closed syncmers and their places, by place."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    h, at = syncmers(code_points(text))
    if not len(h):
        return np.array([struct.unpack("<I", hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:4])[0]], np.uint32), np.zeros(1, np.int64)
    return (h >> np.uint64(32)).astype(np.uint32), at


def as_text(f: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of hash and place of each anchor, as little-endian unsigned 32-bit integers."""
    return base64.b64encode(np.stack([f[0], f[1].astype(np.uint32)], 1).astype("<u4").tobytes()).decode()


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(base64.b64decode(text), "<u4").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].astype(np.int64)


def _numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash with how often it occurred before, as one number, ascending; and where."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    turn = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return (h[order].astype(np.uint64) << np.uint64(32)) | turn.astype(np.uint64), order


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    (x, i), (y, j) = _numbered(a[0]), _numbered(b[0])
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(p):
        return 0.0
    by_place = np.argsort(i[p])
    met = rising(j[q][by_place])
    return met / (len(x) + len(y) - met)


def rising(places: np.ndarray) -> int:
    """Length of the longest rising subsequence of distinct numbers."""
    if (places[1:] > places[:-1]).all():
        return len(places)
    tops: list[int] = []
    for x in places.tolist():
        if not tops or x > tops[-1]:
            tops.append(x)
        else:
            tops[bisect_left(tops, x)] = x
    return len(tops)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(docs: DataFrame, range_docs: int = RANGE_DOCS) -> DataFrame:
    """(part, own, doc_id, text, h: a hash of the text): docs(doc_id, text) in numbered ranges of descending doc_id, each with the first row of the next range behind it (own = false).

    The ranges' bounds, at most MOST_RANGES numbers, are all that the driver sees.
    """
    ranges = min(MOST_RANGES, max(1, -(-docs.count() // range_docs)))
    h = F.xxhash64("text")
    ids = docs.select("doc_id", h.alias("h")).repartitionByRange(ranges, F.col("doc_id").desc_nulls_last(), "h")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.coalesce("doc_id", F.lit(0))).alias("d"), "h")).alias("top")
    tops = sorted((int(r.top.none), r.top.d, r.top.h) for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(first).collect())
    bounds = docs.sparkSession.sparkContext.broadcast(np.array(tops, np.int64).reshape(-1, 3))

    @F.pandas_udf("struct<part: int, top: boolean>")
    def range_of(doc_id: pd.Series, h: pd.Series) -> pd.DataFrame:
        b, none = bounds.value, doc_id.isna().to_numpy()
        own = np.stack([none, -doc_id.fillna(0).to_numpy(np.int64), h.to_numpy(np.int64)], 1)
        both = np.concatenate([b, own])
        bound = np.arange(len(both)) < len(b)
        order = np.lexsort((~bound, both[:, 2], both[:, 1], both[:, 0]))  # a bound before its equals
        part = np.empty(len(both), np.int64)
        part[order] = np.cumsum(bound[order]) - 1
        part = np.maximum(part[len(b) :], 0)
        return pd.DataFrame({"part": part.astype(np.int32), "top": (b[part] == own).all(axis=1)})

    n = max(1, len(tops))
    at, true, false = F.col("at"), F.lit(True), F.lit(False)
    one = F.struct(at["part"].alias("part"), true.alias("own"))
    two = F.struct(F.pmod(at["part"] - 1, F.lit(n)).cast("int").alias("part"), false.alias("own"))
    spread = docs.withColumn("h", h).withColumn("at", range_of("doc_id", "h")).withColumn("to", F.explode(F.when(at["top"], F.array(one, two)).otherwise(F.array(one))))
    return spread.select("to.part", "to.own", "doc_id", "text", "h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each row of docs(doc_id, text), of its edited text, and their likeness; likewise for the next document."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = in_ranges(plain).repartition("part").sortWithinPartitions("part", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "h", "text").select("part", "own", "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def result(held, following):
        (doc_id, text, own), (next_text, next_print) = held, following
        changed = edited(text, next_text)
        f = fingerprint(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_text(own), as_text(f), likeness(own, f), likeness(own, next_print)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = None, None, None
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
        for batch in batches:
            for piece in slices(batch):
                out = []
                for p, own, doc_id, text in zip(*(piece.column(k).to_pylist() for k in range(4))):
                    f = fingerprint(text)
                    if p != part:
                        if held:  # without doc_ids there is no row of a next range: the first follows the last
                            out.append(result(held, first))
                        part, held, first = p, None, (text, f)
                    if held:
                        out.append(result(held, (text, f)))
                    held = (doc_id, text, f) if own else None
                if out:
                    yield pack(out)
        if held:
            yield pack([result(held, first)])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLES: dict[str, str] = {}
