"""Operator 1, LM scoring by a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). The most frequent words, the head (the end is one), make
classes of equal size, by rank; each other word belongs to one of TAILS classes by its first two bytes, and is
distributed in it by its count. Both softmaxes are linear in hashed features of the context: the previous word,
the one before it (skip) and both together, where words outside the head count as their tail class.

Training reads every training document twice: for exact counts of all words, and for the gradient. Tasks read shards of the documents,
count the (word before, previous word, word) triples of some CHUNK_TOKENS tokens at a time, and run weighted Adagrad steps on
batches of contexts from the same weights; what each has changed is averaged by row of weights, in ROUNDS rounds. No triple is shuffled.

What is learnt grows with the corpus. Words that occur at least sqrt(training tokens) / FREQUENT times set a size m: the head
has HEAD * m**2 words in SIDE * m classes of SIDE * m, and ROWS * m rows of hashed weights. Of tokens with a power law
of words that is a head by the square root of the tokens. Memory of the weights ends it at MOST_SIZE (a head of 102,400 words, 800 MB of weights); all
other words keep their exact counts in their tail class. A shard's tokens grow with the rows, so that what shards send stays in proportion to the tokens.

Scoring takes each distinct triple of a batch once, with numpy.

Counts of words in the training documents: those with at least 1/WARM of all tokens are broadcast, so at most WARM; the
others are joined by hash, and none of them can be frequent. Words are counted by a 64-bit hash, five bits of it their tail class.

Every distribution sums to 1, with one event in each tail class for all words that training lacks.

Defined cases: a null text is empty and has one token, the end. Null doc_ids count as the empty text for the held-out
rule. Without training documents N and V are 0. Rows that repeat are scored each; very long texts are scored whole, ties of frequency go to
the smaller hash. An empty table gives an empty result.
Extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, join_checked, join_hot, materialize, mix64, read_table, slices, text_buffer, tokens

#: Classes, and words of a class, of the smallest model; TAILS is that of all.
SIDE, TAILS = 16, 32
HEAD = SIDE * SIDE
START = HEAD + TAILS
#: Rows of hashed weights, for classes and for words.
ROWS = 1 << 13
FREQUENT, MOST_SIZE = 8, 20
WARM = 400_000
ROUNDS, BATCH, RATE = 1, 8192, 0.4
#: Tokens in a training shard: as many for each row of weights, and at least.
ROW_TOKENS, SHARD_TOKENS = 256, 1_000_000
#: Tokens whose triples a task counts before it learns from them.
CHUNK_TOKENS = 3_000_000
END = np.uint64(0x5AFE0E2D << 5)
_LOG10 = math.log10(math.e)


def sequences(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each token of a batch, ends included. A hash's low 5 bits are its word's tail class."""
    start, end, doc, h = tokens(data, bounds)
    n, docs = len(h), len(bounds) - 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data) if n else data
    second = np.where(end - start > 1, lower[np.minimum(start + 1, max(0, len(data) - 1))], 0) if n else start
    tail = mix64(lower[start].astype(np.uint64) * np.uint64(256) + second.astype(np.uint64) + np.uint64(1)) % np.uint64(TAILS) if n else h
    own = np.full(n + docs, END, np.uint64)
    at = np.arange(n) + doc
    own[at] = (h & ~np.uint64(31)) | tail
    many = np.bincount(doc, minlength=docs)
    return np.repeat(np.arange(docs), many + 1), own


@dataclass
class Vocabulary:
    """head: hashes in ascending order and their ids; warm: hashes in ascending order and their counts."""

    head: np.ndarray
    ids: np.ndarray
    head_count: np.ndarray  # by id
    warm: np.ndarray
    warm_count: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    total: int
    distinct: int

    @property
    def words(self) -> int:
        """Size of the head, with places that no word has."""
        return len(self.head_count)

    @property
    def bits(self) -> int:
        """Of an id in a packed triple."""
        return packed_bits(self.words)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids: of head words their own, of others their tail class's."""
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, self.ids[at], self.words + (h & np.uint64(31)).astype(np.int64))

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Counts of warm words, -1 for others."""
        if not len(self.warm):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.warm, h), len(self.warm) - 1)
        return np.where(self.warm[at] == h, self.warm_count[at], -1)


def packed_bits(head: int) -> int:
    return max(11, (head + TAILS).bit_length())


def triples(doc: np.ndarray, ids: np.ndarray, head: int = HEAD) -> np.ndarray:
    """(word before, previous word, word) of each token, packed packed_bits(head) bits each."""
    bits, start = packed_bits(head), head + TAILS
    one, two = np.full(len(ids), start, np.int64), np.full(len(ids), start, np.int64)
    same = doc[1:] == doc[:-1]
    one[1:][same] = ids[:-1][same]
    same = doc[2:] == doc[:-2]
    two[2:][same] = ids[:-2][same]
    return (two << 2 * bits) | (one << bits) | ids


def _hashed(x: np.ndarray, salt: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(x.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(salt)) % np.uint64(rows)).astype(np.int64)


class MaxEnt:
    """Weights: class_w [rows, classes + TAILS] and word_w [rows, per_class], with biases that make the start the words' own frequencies."""

    def __init__(self, class_bias: np.ndarray, word_bias: np.ndarray):
        self.class_bias, self.word_bias = class_bias.astype(np.float32), word_bias.astype(np.float32)
        self.classes, self.per_class = word_bias.shape
        self.head, self.rows = word_bias.size, ROWS * (self.classes // SIDE)
        self.bits = packed_bits(self.head)
        self.class_w = np.zeros((self.rows, self.classes + TAILS), np.float32)
        self.word_w = np.zeros((self.rows, self.per_class), np.float32)

    @classmethod
    def from_counts(cls, v: Vocabulary) -> MaxEnt:
        m = math.isqrt(v.words // HEAD)
        count = v.head_count.reshape(SIDE * m, SIDE * m)
        word = count + 0.01
        classes = np.concatenate([count.sum(1), v.tail_tokens]) + 1.0
        return cls(np.log(classes / classes.sum()), np.log(word / word.sum(1, keepdims=True)))

    def parts(self, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed context, class and place in the class of each triple."""
        word = triple & ((1 << self.bits) - 1)
        head = word < self.head
        return triple >> self.bits, np.where(head, word // self.per_class, self.classes + word - self.head), np.where(head, word % self.per_class, -1)

    def features(self, context: np.ndarray, salt: int | np.ndarray = 0) -> list[np.ndarray]:
        """Rows of the three features of each context: previous word, skip, both. salt: the class, for the words' softmax."""
        by = np.asarray(salt, np.int64) << (2 * self.bits + 2)
        return [_hashed(x | by, k, self.rows) for k, x in enumerate((context & ((1 << self.bits) - 1), context >> self.bits, context), 1)]

    def class_log(self, rows: list[np.ndarray]) -> np.ndarray:
        """In scratch memory, until the next call."""
        x = _row_sums(self.class_w, rows)
        x += self.class_bias
        return _log_softmax(x)

    def word_log(self, rows: list[np.ndarray], group: np.ndarray) -> np.ndarray:
        """In scratch memory, until the next call."""
        x = _row_sums(self.word_w, rows)
        x += _taken("other", self.word_bias, group)
        return _log_softmax(x)

    def log10(self, triple: np.ndarray, block: int = 1 << 13) -> np.ndarray:
        """log10 P(class) and, for head words, of the word in it, of sorted distinct triples."""
        out = np.zeros(len(triple))
        for i in range(0, len(triple), block):
            context, group, place = self.parts(triple[i : i + block])
            new = np.ones(len(context), bool)
            new[1:] = context[1:] != context[:-1]
            at = np.cumsum(new) - 1
            out[i : i + block] = self.class_log(self.features(context[new]))[at, group]
            head = np.flatnonzero(place >= 0)
            if len(head):
                context, group, place = context[head], group[head], place[head]
                new = np.ones(len(context), bool)
                new[1:] = (context[1:] != context[:-1]) | (group[1:] != group[:-1])
                at = np.cumsum(new) - 1
                out[i + head] += self.word_log(self.features(context[new], group[new] + 1), group[new])[at, place]
        return out * _LOG10

    def learn(self, triple: np.ndarray, n: np.ndarray, seed: int, squares: list[np.ndarray] | None = None, epochs: int = 1) -> None:
        """Weighted Adagrad steps over batches of distinct triples and their counts. squares: of gradients so far."""
        squares = squares or self.fresh_squares()
        for turn in range(epochs):
            order = np.argsort(_hashed(triple >> self.bits, 1000 + seed + turn, 1 << 62), kind="stable")  # contexts in random order
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                weight = (n[pick] / n[pick].sum()).astype(np.float32)
                context, group, place = self.parts(triple[pick])
                context, at = np.unique(context, return_inverse=True)
                rows = self.features(context)
                self._step(self.class_w, squares[0], rows, self.class_log(rows), at, group, weight)
                head = np.flatnonzero(place >= 0)
                if len(head):
                    pair, own = np.unique(at[head] * np.int64(self.classes) + group[head], return_inverse=True)
                    context, group = context[pair // self.classes], pair % self.classes
                    rows = self.features(context, group + 1)
                    self._step(self.word_w, squares[1], rows, self.word_log(rows, group), own, place[head], weight[head])

    def fresh_squares(self) -> list[np.ndarray]:
        return [np.full(w.shape, 1e-8, np.float32) for w in (self.class_w, self.word_w)]

    @staticmethod
    def _step(w: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], log: np.ndarray, at: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        """One step; event i of context at[i] is target[i], with weight[i]."""
        g = np.exp(log, out=log)
        g *= -np.bincount(at, weight, len(g)).astype(np.float32)[:, None]
        flat, place = np.unique(at * np.int64(g.shape[1]) + target, return_inverse=True)
        g.reshape(-1)[flat] += np.bincount(place, weight).astype(np.float32)
        for r in rows:
            r = r.astype(np.uint16) if len(w) <= 1 << 16 else r  # sorted by radix
            order = np.argsort(r, kind="stable")
            r = r[order]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            own = r[first].astype(np.int64)
            d = _segment_sums(g, order, first)
            s = _taken("squares", squares, own)
            s += np.multiply(d, d, out=_scratch("ordered", *d.shape))
            squares[own] = s
            d *= RATE
            d /= np.sqrt(s, out=s)
            d += _taken("squares", w, own)
            w[own] = d


_memory: dict[str, np.ndarray] = {}


def _scratch(name: str, n: int, width: int) -> np.ndarray:
    """An array [n, width] of float32 in memory that is used again: fresh memory for each step's arrays costs more time than their sums."""
    have = _memory.get(name)
    if have is None or len(have) < n * width:
        have = _memory[name] = np.empty(n * width, np.float32)
    return have[: n * width].reshape(n, width)


def _taken(name: str, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x[rows] in scratch memory."""
    return np.take(x, rows, axis=0, out=_scratch(name, len(rows), x.shape[1]), mode="clip")


def _segment_sums(x: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows x[order] from each place of first to the next, in scratch memory: by pairs, then pairs of pairs."""
    many = np.diff(np.append(first, len(order)))
    out = _taken("sums", x, order[first])
    long = np.flatnonzero(many > 1)  # most have one row
    if not len(long):
        return out
    many = many[long]
    begin = np.cumsum(many) - many
    place = np.arange(many.sum()) - np.repeat(begin, many)
    rows = _taken("ordered", x, order[np.repeat(first[long], many) + place])
    at = np.arange(len(rows))
    while len(at) > len(long):
        right = np.flatnonzero(place & 1)
        left = at[right - 1]
        pair = _taken("other", rows, left)
        pair += _taken("squares", rows, at[right])
        rows[left] = pair
        stay = place & 1 == 0
        at, place = at[stay], place[stay] >> 1
    out[long] = _taken("other", rows, at)
    return out


def _row_sums(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    x = _taken("log", w, rows[0])
    for r in rows[1:]:
        x += _taken("other", w, r)
    return x


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x, out=_scratch("other", *x.shape)).sum(axis=1, keepdims=True))
    return x


def _summed(docs: DataFrame, key, schema: str) -> DataFrame:
    """(key, n) of the tokens' keys in docs(text), summed within a task as far as memory allows. key: of a batch's documents and hashes."""
    fields = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], schema=fields)

        for batch in batches:
            for part in slices(batch):
                keys, n = np.unique(key(*sequences(*text_buffer(part.column(0)))), return_counts=True)
                held.append((keys, n))
                size += len(keys)
                if size > 2_000_000:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    return docs.select("text").mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, warm: int = WARM) -> Vocabulary:
    """Of counts(key, n) of all training tokens. At most the head and warm rows come to the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(END.view(np.int64))
    frequent = counts.where((F.col("n") >= math.sqrt(total) / FREQUENT) & (F.col("key") != end)).count() + 1
    size = HEAD * min(MOST_SIZE, max(1, math.isqrt(frequent // HEAD))) ** 2
    rows = counts.where(F.col("key") != end).orderBy(F.col("n").desc(), "key").limit(size - 1).collect()
    rows += counts.where(F.col("key") == end).collect() or [(end, 0)]
    rows.sort(key=lambda r: (-r[1], r[0]))
    head, head_count = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.zeros(size)
    head_count[: len(rows)] = [r[1] for r in rows]
    order = np.argsort(head)
    heads = counts.sparkSession.createDataFrame([(int(r[0]),) for r in rows], "key long")
    tail = counts.join(F.broadcast(heads), "key", "left_anti").groupBy(F.col("key").bitwiseAND(F.lit(31)).alias("t")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    tokens_of, words_of = np.zeros(TAILS), np.zeros(TAILS)
    for r in tail:
        tokens_of[r.t], words_of[r.t] = r.n, r.words
    table = counts.where(F.col("n") >= max(1, -(-total // warm))).toArrow() if total else None
    keys = table.column("key").to_numpy().view(np.uint64) if table else np.zeros(0, np.uint64)
    n = table.column("n").to_numpy() if table else np.zeros(0, np.int64)
    extra = ~np.isin(head, keys)  # the head's counts are always at hand
    keys, n = np.concatenate([keys, head[extra]]), np.concatenate([n, head_count[: len(rows)][extra].astype(np.int64)])
    at = np.argsort(keys)
    return Vocabulary(head[order], order, head_count, keys[at], n[at], tokens_of, words_of, int(total), int(distinct))


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> MaxEnt:
    """Distributed gradient updates over the triples of docs(text)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(v)
    model = MaxEnt.from_counts(v)
    shards = max(1, round(v.total / max(SHARD_TOKENS, ROW_TOKENS * model.rows)))
    width = model.classes + TAILS + model.per_class
    fields = pa.schema([("row", pa.int32()), ("change", pa.binary()), ("n", pa.int64())])
    for turn in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            begun, own = now.value, None
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for batch in batches:
                for part in slices(batch):
                    if own is None:
                        own = MaxEnt(begun.class_bias, begun.word_bias)
                        own.class_w, own.word_w = begun.class_w.copy(), begun.word_w.copy()
                        squares = own.fresh_squares()
                    doc, h = sequences(*text_buffer(part.column(0)))
                    held.append(np.unique(triples(doc, _ids(sent.value, h), sent.value.words), return_counts=True))
                    size += len(h)
                    if size >= CHUNK_TOKENS:
                        counted = _merged(held)
                        held, size = [], 0
                        own.learn(*counted, turn, squares)
            if held:
                counted = _merged(held)
                held = []
                own.learn(*counted, turn, squares)
            if own is None:
                return
            for i in range(0, own.rows, ROWS):
                change = np.concatenate([own.class_w[i : i + ROWS] - begun.class_w[i : i + ROWS], own.word_w[i : i + ROWS] - begun.word_w[i : i + ROWS]], axis=1)
                rows = np.flatnonzero(np.abs(change).max(axis=1) > 0)
                yield pa.RecordBatch.from_arrays([pa.array((rows + i).astype(np.int32)), pa.array([x.tobytes() for x in change[rows]], pa.binary()), pa.array(np.ones(len(rows), np.int64))], schema=fields)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for row, change in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    x = np.frombuffer(change, np.float32)
                    if row in sums:
                        sums[row][0] += x
                        sums[row][1] += 1
                    else:
                        sums[row] = [x.astype(np.float64), 1]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(s / n).astype(np.float32).tobytes() for s, n in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], schema=fields)

        parts = docs.select("text").coalesce(shards).mapInArrow(run, "row int, change binary, n long")
        changes = parts.repartition("row").mapInArrow(add, "row int, change binary, n long").collect()  # at most model.rows rows
        for row, change, _ in changes:
            x = np.frombuffer(bytes(change), np.float32)
            model.class_w[row] += x[: width - model.per_class]
            model.word_w[row] += x[width - model.per_class :]
    return model


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    del order
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _ids(v: Vocabulary, h: np.ndarray) -> np.ndarray:
    own, at = np.unique(h, return_inverse=True)
    return v.find(own)[at]


def scored(docs: DataFrame, counts: DataFrame, v: Vocabulary, model: MaxEnt) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((v, model))
    fields = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = sent.value
        tail_log = np.log10(v.tail_tokens + v.tail_words + 1)
        for batch in batches:
            for part in slices(batch):
                doc, h = sequences(*text_buffer(part.column(2)))
                docs = part.num_rows
                own, at = np.unique(h, return_inverse=True)
                ids, count = v.find(own), v.counts(own)
                log_count = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1), 0.0)
                in_tail = ids >= v.words
                tail_part = np.where(in_tail, np.where(count >= 0, log_count, 0.0) - tail_log[np.maximum(ids - v.words, 0)], 0.0)
                triple, where = np.unique(triples(doc, ids[at], v.words), return_inverse=True)
                score = np.bincount(doc, model.log10(triple)[where] + tail_part[at], docs)
                cold = np.flatnonzero((count < 0)[at])
                pair, times = np.unique(doc[cold] * np.int64(len(own)) + at[cold], return_counts=True)
                begin = np.searchsorted(pair, np.arange(docs + 1) * np.int64(len(own)))
                words = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(own[pair % max(1, len(own))].view(np.int64)))
                many = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(times.astype(np.int32)))
                known = np.bincount(doc, (count > 0)[at], docs).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.bincount(doc, minlength=docs)), pa.array(known), pa.array(np.bincount(doc, log_count[at], docs)), pa.array(score), words, many], schema=fields)

    rows = docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), "text")
    rows = materialize(rows.mapInArrow(run, "doc_id long, row long, n_tokens long, n_known long, base double, score double, words array<long>, times array<int>"), "scored")
    cold = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("key"), F.col("w.times").alias("times"))
    rare = counts.where(F.col("n") < max(1, -(-v.total // WARM)))
    met = cold.join(rare.hint("merge"), "key")  # words that training lacks add log10(0 + 1)
    met = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    many = materialize(rows.groupBy("row").agg(F.count("*").alias("m")).where("m > 1"), "repeated-rows")  # their words have been summed up
    met = join_checked(met, many, ["row"]).withColumn("m", F.coalesce("m", F.lit(1)))
    met = met.select("row", (F.col("more") / F.col("m")).alias("more"), (F.col("more_known") / F.col("m")).cast("long").alias("more_known"), F.col("m").alias("weight"))
    out = join_hot(rows.drop("words", "times"), materialize(met, "rare-words"), "row", "weight", rows.count())
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(math.log10(v.total + v.distinct + 1))).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def lm_scores(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Scores of docs(doc_id, text) by a model trained on training(text)."""
    counts = materialize(_summed(training, lambda doc, h: h.view(np.int64), "key long, n long"), "counts")
    v = vocabulary(counts)
    return scored(docs, counts, v, train(training, v))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scores(docs, docs.where(crc_mod("doc_id", 7) != 2))
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_lm_score": op1_lm_score}
ORACLES: dict[str, str] = {}
