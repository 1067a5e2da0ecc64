"""Operator 12, toxic passages by maximum-scoring segments.

Every word has log-odds of standing in toxic rather than other texts. They come from counts of documents (how many of each
class hold the word) under Dirichlet priors nested along the word's beginnings: a beginning of 3 letters has the corpus as
its prior, one of 4 the one of 3, and so on up to the whole word, so that a rare or unseen word inherits from its beginning.
Only beginnings and words whose log-odds are significant are kept; every other word has the score -DRIFT, so that texts
without toxic words run downwards. One linear scan finds all maximal segments (Ruzzo and Tompa's, over the words that score above 0; what lies
between is one sum). A segment of score S in a text of n words has the extreme-value score lambda * S - ln(K * n), with lambda from the
scores of words in clean texts and K from how many segments they have. A text's evidence is the best sum over its r highest
segments minus ln(r!); a logistic curve over it and ln(n) turns it into a probability. The curve and K are fitted on texts scored by counts without their own third.

The fit uses a bounded sample of the labels: per class the SAMPLE_DOCS labelled documents with the smallest hash of their doc_id,
with their whole texts, counted by tasks. What comes to the driver: the significant beginnings and words, and one number a document of the sample.

Defined cases: a null text counts as empty; an empty text has the evidence of a text without toxic words and one word of length. Words are runs of letters and
digits in lower case; very long texts are scored whole, in pieces cut at blanks. Labels that are null or neither 0 nor 1, or without a document, are not used;
labels that repeat a doc_id with the same value count once. Without labels of both classes the score is the share of label 1, or 0 without any. Rows that
repeat a doc_id are scored each. Ties: segments of equal score count in order of place; of equal hashes in the sample the smaller doc_id is taken. An empty
table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, read_table, slices

SAMPLE_DOCS = 20_000
SEED = 83
#: Lengths of the beginnings of words that are nodes above the whole word.
BEGINNINGS = range(3, 9)
#: Weight of a node's prior, in documents.
PRIOR = 2.0
#: Standard deviations by which a node's log-odds must exceed 0.
LEAST_Z = 4.0
#: What a word without toxic log-odds takes from a segment.
DRIFT = 0.2
FOLDS = 3
PIECE = 1 << 20
MEMO = 200_000
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    """scores: log-odds minus DRIFT of beginnings (as they are) and whole words (with a blank behind); curve: weights of the evidence, of ln(words) and 1."""

    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    log_k: float = 0.0
    curve: tuple[float, float, float] = (0.0, 0.0, -500.0)


def nodes(word: str) -> list[str]:
    """A word's beginnings and itself, from the shortest."""
    return [word[:k] for k in BEGINNINGS if k < len(word)] + [word + " "]


def pieces(text: str, most: int = PIECE) -> Iterator[tuple[int, str]]:
    """(place, part): a long text in parts that end between words."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and (text[end].isalnum() or text[end - 1].isalnum()):
            end += 1
        yield at, text[at:end]
        at = end
    yield at, text[at:]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, float] = {}

    def word(self, w: str) -> float:
        """The score of the longest known node of a word in lower case."""
        got = self.memo.get(w)
        if got is None:
            got = next((s for s in map(self.model.scores.get, reversed(nodes(w))) if s is not None), -DRIFT)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(w) < 64:
                self.memo[w] = got
        return got

    def marks(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """How many words a text has, and (number, score) of those that score above 0. A word that repeats the one before says nothing new and counts as any other."""
        n, found, last = 0, [], ""
        for _, part in pieces(text):
            words = _WORD.findall(part.lower())
            found += [(n + i, s) for i, (w, before, s) in enumerate(zip(words, [last, *words], map(self.word, words))) if s > 0 and w != before]
            n, last = n + len(words), words[-1] if words else last
        return n, found

    def normal(self, score: float, n: int) -> float:
        return self.model.decay * score - self.model.log_k - math.log(max(n, 1))

    def evidence(self, n: int, scores: list[float]) -> float:
        """The best over r of the sum of the r highest extreme-value scores minus ln(r!)."""
        best, total = -math.inf, 0.0
        for r, s in enumerate(sorted(scores, reverse=True) or [0.0], 1):
            total += self.normal(s, n) - math.log(r)
            if total <= best:
                break
            best = total
        return best

    def curve(self, n: int, evidence: float) -> float:
        return float(1 / (1 + math.exp(-min(max(sum(a * b for a, b in zip(self.model.curve, features(n, evidence))), -500), 500))))

    def score(self, text: str | None) -> tuple[float, float]:
        """(score, evidence) of a text."""
        n, found = self.marks(text or "")
        e = self.evidence(n, [s for *_, s in segments(found)])
        return self.curve(n, e), e

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """(first, end, score, expected) of every significant segment: its characters, its score, and how many as good a clean text of this length has (below 0.05)."""
        n, found = self.marks(text or "")
        kept = [(a, b, s, math.exp(-self.normal(s, n))) for a, b, s in segments(found)]
        kept = [k for k in kept if k[3] < 0.05]
        if not kept:
            return []
        wanted = {w for a, b, *_ in kept for w in (a, b)}
        places, i = {}, 0
        for at, part in pieces(text):
            for m in _WORD.finditer(part):
                if i in wanted:
                    places[i] = (at + m.start(), at + m.end())
                i += 1
        return [(places[a][0], places[b][1], s, e) for a, b, s, e in kept if a in places and b in places]


def features(n: int, evidence: float) -> tuple[float, float, float]:
    return min(max(evidence, -30.0), 30.0), math.log(max(n, 1)), 1.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def segments(found: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments, in order: found has the (number, score) of words above 0, every other word scores -drift.

    Each candidate keeps the sums before and behind it. A new one joins leftwards to the nearest candidate that begins lower
    while it ends higher than that one; each candidate is merged or passed over once on the way.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum behind, nearest candidate with a lower sum before (or -1)
    total, at = 0.0, -1
    for place, score in found:
        total -= drift * (place - at - 1)
        first, last, low, high, at = place, place, total, total + score, place
        total = high
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, last, low, high, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


def build(counts: dict[str, tuple[float, float]], totals: tuple[float, float]) -> dict[str, float]:
    """Scores of the significant nodes. counts: documents with a node, (other, toxic); totals: documents of each class."""
    base = (totals[1] + 0.5) / (totals[0] + totals[1] + 1)
    out: dict[str, float] = {}
    for node, (clean, toxic) in counts.items():
        word = node.rstrip(" ")
        chain = [word[:k] for k in BEGINNINGS if k < len(word) and word[:k] in counts]
        above = base
        for b, below in zip(chain, [*chain[1:], node]):  # each level adds what it has besides the next, so that nothing counts twice
            c, t = (max(0, x - y) for x, y in zip(counts[b], counts[below]))
            above = (t + PRIOR * above) / (c + t + PRIOR)
        p = (toxic + PRIOR * above) / (clean + toxic + PRIOR)
        odds = math.log(p / (1 - p)) - math.log(base / (1 - base))
        if odds > LEAST_Z * math.sqrt(1 / (toxic + PRIOR * base) + 1 / (clean + PRIOR * (1 - base))):
            out[node] = odds - DRIFT
    return {k: v for k, v in out.items() if v > 0}


def decay_of(tally: Counter) -> float:
    """The positive root of sum p(s) e^(root s) = 1, for scores (rounded) of clean words and how often they occur; 1 where there is none."""
    n = sum(tally.values())
    s, p = np.array(list(tally), float), np.array(list(tally.values()), float) / max(n, 1)
    if not n or s.max() <= 0 or s @ p >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while p @ np.exp(hi * s) < 1:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p @ np.exp(mid * s) < 1 else (lo, mid)
    return hi


def sample_of(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(toxic, fold, text) of the sample: rows that repeat a doc_id count as documents of their own. Two small lookups: at most 2 * sample_docs ids are broadcast."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").distinct()
    place = F.xxhash64(F.lit(SEED), "doc_id")
    picked = [labels.where(F.col("toxic") == t).withColumn("place", place).orderBy("place", "doc_id").limit(sample_docs) for t in (0, 1)]
    picks = materialize(picked[0].unionByName(picked[1]), "toxic-picks")
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picks), "doc_id").select("toxic", F.pmod("place", F.lit(FOLDS)).cast("int").alias("fold"), "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, toxic, fold, n): in how many documents of the task's batch a node stands; the empty node counts documents."""
    for batch in batches:
        for part in slices(batch):
            counts: Counter = Counter()
            for toxic, fold, text in zip(*(c.to_pylist() for c in part.columns)):
                words = {w for _, p in pieces(text) for w in _WORD.findall(p.lower())}
                counts.update((x, toxic, fold) for x in {x for w in words for x in nodes(w)} | {""})
            if counts:
                keys, n = zip(*counts.items())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*keys), (pa.string(), pa.int32(), pa.int32()))), pa.array(n, pa.int64())], names=["node", "toxic", "fold", "n"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    spark = docs.sparkSession
    sample = materialize(sample_of(docs, labels, sample_docs), "toxic-sample")
    counts = sample.mapInArrow(_counted, "node string, toxic int, fold int, n long").groupBy("node")
    each = {(t, f): f"n{t}{f}" for t in (0, 1) for f in range(FOLDS)}
    counts = counts.agg(*(F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(c) for (t, f), c in each.items()))
    counts = materialize(counts, "toxic-counts")
    whole = counts.where("node = ''").first()
    totals = {k: whole[c] if whole else 0 for k, c in each.items()}
    by_class = [sum(totals[t, f] for f in range(FOLDS)) for t in (0, 1)]
    if not all(by_class):
        share = by_class[1] / max(1, sum(by_class))
        return Model(curve=(0.0, 0.0, math.log(share / (1 - share)) if 0 < share < 1 else (500.0 if share else -500.0)))
    # a node in less than two toxic documents, or with at most the corpus's share of them, is significant in no fold
    clean, toxic = (sum(F.col(each[t, f]) for f in range(FOLDS)) for t in (0, 1))
    rows = counts.where((F.col("node") != "") & (toxic >= 2) & (toxic * by_class[0] > clean * by_class[1])).collect()
    found = {r.node: [[r[each[t, f]] for t in (0, 1)] for f in range(FOLDS)] for r in rows}

    def fitted(without: int | None) -> dict[str, float]:
        use = [f for f in range(FOLDS) if f != without]
        return build({k: tuple(sum(v[f][t] for f in use) for t in (0, 1)) for k, v in found.items()}, tuple(sum(totals[t, f] for f in use) for t in (0, 1)))

    sent = spark.sparkContext.broadcast([fitted(f) for f in range(FOLDS)])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(toxic, n, scores, tops): words, segments' scores, scores of words above 0 of each document, by counts without its fold."""
        scorers = [Scorer(Model(s)) for s in sent.value]
        for batch in batches:
            for part in slices(batch):
                got = [(t, *scorers[f].marks(text)) for t, f, text in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_pydict({
                    "toxic": pa.array([t for t, *_ in got], pa.int32()), "n": pa.array([n for _, n, _ in got], pa.int64()),
                    "scores": pa.array([[s for *_, s in segments(m)] for *_, m in got], pa.list_(pa.float64())),
                    "tops": pa.array([[round(s, 1) for _, s in m] for *_, m in got], pa.list_(pa.float64())),
                })

    marks = materialize(sample.mapInArrow(marked, "toxic int, n long, scores array<double>, tops array<double>"), "toxic-marks")
    clean_marks = marks.where("toxic = 0")
    words, docs_n = clean_marks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tops = {r[0]: r[1] for r in clean_marks.select(F.explode("tops").alias("s")).groupBy("s").count().collect()}  # scores rounded to a tenth: few
    tally = Counter(tops)
    tally[-DRIFT] += max(0, words - sum(tops.values()))
    decay = decay_of(tally)
    least = 0.5  # K: segments of at least this score that clean texts have, against what n words would have with K = 1
    many = clean_marks.select(F.explode("scores").alias("s")).where(F.col("s") >= least).count()
    log_k = math.log((many + 0.5) / (max(words, docs_n, 1) * math.exp(-decay * least)))
    scorer = Scorer(Model({}, decay, log_k))
    rest = marks.select("toxic", "n", F.slice(F.reverse(F.array_sort("scores")), 1, 64).alias("scores")).collect()  # the evidence of the sample never needs more than the highest few
    x, y = np.array([features(r.n, scorer.evidence(r.n, r.scores)) for r in rest]), np.array([float(r.toxic) for r in rest])
    return Model(fitted(None), decay, log_k, tuple(map(float, logistic(x, y))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence, n_passages) of each row of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in slices(batch):
                got = []
                for text in part.column(1).to_pylist():
                    n, found = scorer.marks(text or "")
                    s = [v for *_, v in segments(found)]
                    e = scorer.evidence(n, s)
                    got.append((scorer.curve(n, e), e, sum(math.exp(-scorer.normal(v, n)) < 0.05 for v in s)))
                cols = zip(*got) if got else ([], [], [])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.float64(), pa.int64())))], names=["doc_id", "score", "evidence", "n_passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence double, n_passages long")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first, end, score, expected, text): every significant passage of each row of docs(doc_id, text), places in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in slices(batch):
                rows = [(i, *p, text[p[0] : p[1]]) for i, text in zip(*(c.to_pylist() for c in part.columns)) for p in scorer.passages(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first long, end long, score double, expected double, text string")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: the others are held out."""
    return labels.where(crc_mod("doc_id", 3) != 1)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, training_labels(read_table(spark, sf_dir, "labels")))
    held_out = (crc_mod("doc_id", 3) == 1).alias("held_out")
    return scored(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence", "n_passages")


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
