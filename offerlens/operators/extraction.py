"""Offers extracted from raw listings: a grammar of amounts, a trained score for which of them is the price, a table function.

A text is cut into paragraphs at blank lines. In each, the amounts of money and the percentages are read; candidates for its price
are the amounts themselves and what two of them that stand close together give (a usual price less a discount, or less so many per cent).
A logistic model of the words around them tells which candidate is the price. A paragraph whose best candidate is not likely, or that
has two likely ones of different values, has no clear price and gives no offer: "$30 off" and "reduced by $30" are no prices.

Defined cases: a null or empty text, or one without amounts, gives no offer. Very long texts are read whole, in time in proportion
to their length. Equal candidates count once; of equally likely ones the earlier is taken. Amounts of 0 are no prices.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Hashed features of the score.
WIDTH = 1 << 13
#: Different candidates that a task, and the driver, hold at a time (about 50 MB); errors are whole parts of 1 / _FINE, so 2^33 candidates have an exact sum.
HELD, _FINE = 100_000, 2.0**30
#: A discount and the price that it is taken off stand at most so many amounts apart.
APART = 2
#: An amount is no part of a longer number, an address of the net or a row of signs: "$$$ 170.116.163.254" and "555-0569%%%" have none.
_MONEY, _RATE = r"(?<![$€£])[$€£]\s?\d[\d,]*(?:\.\d{1,2})?(?!\d|\.\d)", r"(?<![\d.,])\d{1,2}(?:\.\d+)?\s?%(?!%)"
_AMOUNT = re.compile(rf"(?P<money>{_MONEY})|(?P<rate>{_RATE})")
_TOKEN = re.compile(r"(?P<word>[^\W\d_]+)|(?P<stop>[.;!?:]|\n)")
#: Words that a context reaches, and the letters before an amount in which they are looked for first.
REACH, _NEAR = 3, 64
_BLANK = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
OFFER = "offer int, product string, price double, confidence double, n_words int"
_FIELDS = tuple(f.split()[0] for f in OFFER.split(", "))


def _context(tokens: list[tuple[str, str]], i: int, mark: str) -> list[str]:
    """The words before and behind token i within its sentence, with their distance."""
    out, near = [], {}
    for step, side in ((-1, "b"), (1, "a")):
        for d in range(1, REACH + 1):
            k = i + step * d
            kind, word = tokens[k] if 0 <= k < len(tokens) else ("stop", "")
            word = "|" if kind == "stop" else f"<{kind}>" if kind != "word" else word
            near[side, d] = word
            out.append(f"{mark}{side}{d}:{word}")
            if d < REACH:
                out.append(f"{mark}{side}:{word}")
            if kind == "stop":
                break
    out.append(f"{mark}ab:{near['b', 1]},{near['a', 1]}")
    return out


def _between(paragraph: str, start: int, end: int) -> list[tuple[str, str]]:
    """The tokens between two amounts, but of many only the first and the last REACH: no context sees the others."""
    found = lambda at: ((m.lastgroup or "", m[0].lower()) for m in _TOKEN.finditer(paragraph, at, end))
    first = list(islice(found(start), 2 * REACH + 1))
    if len(first) <= 2 * REACH:
        return first
    size = _NEAR
    while True:  # the first of the last tokens may be cut
        last = list(found(max(start, end - size)))
        if len(last) > REACH or end - size <= start:
            return first[:REACH] + last[-REACH:]
        size *= 2


def _tokens(paragraph: str) -> list[tuple[str, str]]:
    """(kind, text) of the amounts and of what their contexts reach, by place."""
    out, at = [], 0
    for m in _AMOUNT.finditer(paragraph):
        out += [*_between(paragraph, at, m.start()), (m.lastgroup or "", m[0].lower())]
        at = m.end()
    return out + _between(paragraph, at, len(paragraph)) if out else []


def candidates(paragraph: str) -> list[tuple[float, list[str]]]:
    """(value, features) of each possible price, by place."""
    tokens = _tokens(paragraph)
    found = []  # (token, kind, value, context)
    for i, (kind, t) in enumerate(tokens):
        if kind in ("money", "rate"):
            found.append((i, kind, float(re.sub(r"[^\d.]", "", t)), _context(tokens, i, "")))
    out = []
    for x, (_, kind, value, context) in enumerate(found):
        if kind == "money" and value > 0:
            out.append((value, ["bias", *(f"own {c}" for c in context)]))
        for _, other, taken, around in (*found[max(0, x - APART) : x], *found[x + 1 : x + 1 + APART]):
            if kind == "money" and (rest := round(value * (1 - taken / 100) if other == "rate" else value - taken, 2)) > 0 and rest < value:
                out.append((rest, ["less", f"less {other}", *(f"of {c}" for c in context), *(f"taken {other} {c}" for c in around)]))
    return out


def _hashed(features: list[str]) -> list[int]:
    return [crc32(f.encode()) % WIDTH for f in features]


Example = tuple[tuple[int, ...], bool]


def _counted(listings: Iterable[tuple[str, float | None]], most: int | None = None) -> Iterator[Counter[Example]]:
    """How often each (hashed features, right) occurs among the candidates of (text, price or None) pairs; a candidate is right if it equals the price. Handed on whenever `most` are held."""
    held: Counter[Example] = Counter()
    for text, price in listings:
        for paragraph in _BLANK.split(text):
            for value, features in candidates(paragraph):
                held[tuple(_hashed(features)), price is not None and abs(value - price) < 0.005] += 1
            if most and len(held) >= most:
                yield held
                held = Counter()
    yield held


def _flat(examples: list[tuple[Sequence[int], bool, int]]) -> tuple[np.ndarray, ...]:
    """(features, the example of each, whether it is right, how often it occurs)."""
    sizes = [len(e[0]) for e in examples]
    return np.fromiter(chain.from_iterable(e[0] for e in examples), np.int64, sum(sizes)), np.repeat(np.arange(len(sizes)), sizes), np.array([float(e[1]) for e in examples]), np.array([e[2] for e in examples], np.int64)


def _gradient(weights: np.ndarray, at: np.ndarray, who: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums by feature in whole parts of _FINE, so that they don't depend on the order of the examples nor on who adds them."""
    p = 1 / (1 + np.exp(-np.clip(np.bincount(who, weights[at], len(right)), -50, 50)))
    sums = np.zeros(WIDTH, np.int64)
    np.add.at(sums, at, (np.rint((right - p) * _FINE).astype(np.int64) * n)[who])
    return sums


def _learned(gradient: Callable[[np.ndarray], np.ndarray], total: int, epochs: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Weights by full gradient steps (Adagrad) over `total` candidates."""
    weights, squares = np.zeros(WIDTH), np.full(WIDTH, 1e-2)
    for _ in range(epochs if total else 0):
        g = gradient(weights) / _FINE - ridge * total * weights
        squares += g * g
        weights += rate * g / np.sqrt(squares)
    return weights


def fit(listings: list[tuple[str, float | None]], epochs: int = 60, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Weights from (text, price or None) pairs in one process."""
    examples = [(*e, n) for held in _counted(listings) for e, n in held.items()]
    flat = _flat(examples)
    return _learned(lambda w: _gradient(w, *flat), int(flat[3].sum()), epochs, rate, ridge)


def offers(text: str | None, weights: np.ndarray, least: float = 0.5) -> Iterator[tuple[int, str, float, float, int]]:
    """(number, product, price, confidence, distinct words of the product) of each paragraph with a clear price. product: its sentences without amounts."""
    number = 0
    for paragraph in _BLANK.split(text or ""):
        likely: dict[float, float] = {}
        for value, features in candidates(paragraph):
            score = float(weights[_hashed(features)].sum())
            likely[value] = max(likely.get(value, 0.0), 1 / (1 + math.exp(-max(-50.0, min(50.0, score)))))
        above = [v for v, p in likely.items() if p >= least]
        if len(above) == 1:
            product = " ".join(" ".join(s for s in _SENTENCE.split(paragraph) if s and not _AMOUNT.search(s)).split())
            yield number, product, above[0], likely[above[0]], len(set(product.split()))
            number += 1


def train_on(listings: DataFrame, most: int | None = None, held: int = HELD) -> np.ndarray:
    """Weights from all listings(text, price), price null where none is clear; the same as fit gives for their rows. Tasks count equal candidates, of which
    there are few, as their features are the words close to amounts. Up to `held` different ones are learned from here, more by tasks.

    most: learn from a sample only, the `most` rows with the smallest hash of their text. The hashes that can be among them are counted first, so that few rows are sorted."""
    given = listings.where("text is not null").select("text", F.col("price").cast("double").alias("price"))
    if most is not None:
        return fit([(r.text, r.price) for r in _smallest(given, most)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t, p) for b in batches for t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for some in _counted(rows, HELD):
            at, right = zip(*some) if some else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(right, pa.bool_()), pa.array(some.values(), pa.int64())], names=["at", "right", "n"])

    examples = given.mapInArrow(count, "at array<int>, right boolean, n long").groupBy("at", "right").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    try:
        different, total = examples.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if different <= held:
            flat = _flat(examples.collect())
            return _learned(lambda w: _gradient(w, *flat), total)
        return _learned(lambda w: _gradient_by_tasks(examples, w), total)
    finally:
        examples.unpersist()


def _gradient_by_tasks(examples: DataFrame, weights: np.ndarray) -> np.ndarray:
    sent = examples.sparkSession.sparkContext.broadcast(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(WIDTH, np.int64)
        for b in batches:
            sums += _gradient(sent.value, *_flat(list(zip(*(c.to_pylist() for c in b.columns)))))
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], names=["feature", "part"])

    rows = examples.mapInArrow(add, "feature int, part long").groupBy("feature").agg(F.sum("part").alias("part")).toArrow()  # at most one row a feature
    out = np.zeros(WIDTH, np.int64)
    out[rows.column("feature").to_numpy()] = rows.column("part").to_numpy()
    sent.destroy()
    return out


def _smallest(given: DataFrame, most: int) -> list[Row]:
    given = given.withColumn("h", F.xxhash64("text"))
    # the first 2^16-th parts of the range of hashes that hold enough rows: at most one row a part comes here
    parts = given.groupBy(F.shiftright("h", 48).alias("part")).count().orderBy("part").collect()
    ends = np.cumsum([r["count"] for r in parts])
    if not len(ends):
        return []
    last = parts[min(len(parts) - 1, int(np.searchsorted(ends, most)))]["part"]
    return given.where(F.shiftright("h", 48) <= last).orderBy("h", "text").limit(most).collect()


def register(spark: SparkSession, weights: np.ndarray, name: str = "offers", least: float = 0.5) -> str:
    """Registers the table function that `SELECT ... FROM listings, LATERAL offers(text)` calls. The weights (64 KB) go with it."""
    sent = weights.astype(np.float64)

    class Offers:
        def eval(self, text: str) -> Iterator[tuple[int, str, float, float, int]]:
            yield from offers(text, sent, least)

    spark.udtf.register(name, udtf(Offers, returnType=OFFER, useArrow=True))
    return name


def extracted(listings: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The offers of listings(text, ...) beside their other columns. Texts go through Python by batches; the table function, which SQL calls, goes row by row."""
    sent = listings.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(_FIELDS, o)) for o in offers(t, sent.value, least)])

    found = F.pandas_udf(of, f"array<struct<{', '.join(f.replace(' ', ': ') for f in OFFER.split(', '))}>>")
    return listings.select("*", F.inline(found(F.col("text"))))


def selected(found: DataFrame, n: int, *key: str) -> DataFrame:
    """The n offers with the most detailed product, then the clearest price, then the smallest key."""
    return found.orderBy(F.desc("n_words"), F.desc(F.round("confidence", 6)), *key).limit(n)


#: Sentences of labelled listings by their number; P price, L usual price, O discount.
CLAUSES = ("Now only {P}.", "Was {L}, now {P}.", "Take {O} off the usual {L} price.", "Reduced by {O} to {P}.", "Get it for {P} after a {O} coupon.", "Save {O} today.", "The list price is {L} and you save 25%.", "Price: {P} plus $5.99 shipping.", "Shipping is $5.99, call for the price.", "Enjoy 25% off {L} this week.", "Reduced by {O} this week.", "It costs {P}, which is {O} less than elsewhere.")
#: Which of them state no price.
UNCLEAR = (5, 8, 10)


def labelled(texts: DataFrame, number: Column) -> DataFrame:
    """texts(body, ...) as listings: text, the body with one of CLAUSES behind it, and price, null where it states none; by a number of the row."""
    clause, size = F.pmod(number, F.lit(len(CLAUSES))).cast("int"), F.lit(100) + F.pmod(number * 7, F.lit(397))
    taken, money = F.lit(10) + F.pmod(number, F.lit(83)), lambda c: F.concat(F.lit("$"), F.format_number(c.cast("double"), 2))
    price, usual = (3 * size).cast("double"), F.when(clause.isin(6, 9), 4 * size).otherwise(3 * size + taken).cast("double")
    said = F.element_at(F.array(*map(F.lit, CLAUSES)), clause + 1)
    for mark, value in (("{P}", price), ("{L}", usual), ("{O}", taken)):
        said = F.replace(said, F.lit(mark), money(value))
    return texts.select(*(c for c in texts.columns if c != "body"), F.concat_ws("\n", F.coalesce("body", F.lit("")), said).alias("text"), F.when(~clause.isin(*UNCLEAR), price).alias("price"))
