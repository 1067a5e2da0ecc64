"""Price models behind one interface: scorer(df) -> df with a column of prices. Deterministic stand-ins for remote models."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import murmur_buckets
from ..functions.money import ensemble, from_target, to_target
from ..functions.text import cut

Scorer = Callable[[DataFrame], DataFrame]
#: Buckets of hashed words.
WORDS = 5000
#: Texts whose words a network sees as one dense matrix: 10 MB of 5,000 words.
SCORED = 256


def group_mean(known: DataFrame, by: list[str], out: str) -> Scorer:
    """The mean known price of the same group: a specialist in small."""
    means = known.groupBy(*by).agg(F.avg("price").alias(out))
    return lambda df: df.join(means, by, "left")


def text_features(text: str = "text") -> Pipeline:
    """Hashed binary bag of words of two characters or more, without English stop words, scaled to length 1."""
    words = RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True)
    return Pipeline(stages=[words, StopWordsRemover(inputCol="__words", outputCol="__kept"), HashingTF(inputCol="__kept", outputCol="__counts", numFeatures=WORDS, binary=True), Normalizer(inputCol="__counts", outputCol="features", p=2.0)])


def words_of(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct words of two characters or more, in lower case, without stop words (those of English unless given)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1))
    stop = StopWordsRemover.loadDefaultStopWords("english") if stop is None else stop
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def word_buckets(text: Column, n: int = WORDS, stop: list[str] | None = None) -> Column:
    """The buckets of a binary bag of words, ascending: the first 32 bits of each word's MD5, modulo n."""
    return F.array_sort(F.array_distinct(F.transform(words_of(text, stop), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % n)))


def murmur_word_buckets(text: Column, n: int = WORDS, stop: list[str] | None = None) -> Column:
    """The same by the absolute value of MurmurHash3 (32 bits, seed 0), modulo n, for weights that were trained elsewhere on words hashed so. Such weights also need their own list of stop words."""
    return murmur_buckets(words_of(text, stop), n)


def text_regression(known: DataFrame, text: str, out: str, ridge: float = 0.1) -> Scorer:
    """A linear model of the standardised log price on hashed words, trained on known(text, price). A null text has no words."""
    given = lambda df: df.withColumn("__text", F.coalesce(text, F.lit("")))
    prepare = text_features("__text").fit(given(known))
    rows = prepare.transform(given(known.where("price is not null"))).withColumn("label", to_target(F.col("price")))
    model = LinearRegression(featuresCol="features", labelCol="label", predictionCol="__p", regParam=ridge, maxIter=20, solver="l-bfgs").fit(rows)
    drop = ["__text", "__words", "__kept", "__counts", "features", "__p"]
    return lambda df: model.transform(prepare.transform(given(df))).withColumn(out, from_target(F.col("__p"))).drop(*drop)


@dataclass
class ResidualNetwork:
    """A residual multilayer network's weights, for inference with numpy; random(...) makes a small seeded one."""

    first: dict
    blocks: list[tuple[dict, dict]] = field(default_factory=list)
    last: dict = field(default_factory=dict)

    @staticmethod
    def _layer(rng: np.random.Generator, n: int, m: int, norm: bool = True) -> dict:
        out = {"w": rng.normal(0, n**-0.5, (n, m)), "b": np.zeros(m)}
        return out | {"gain": np.ones(m), "shift": np.zeros(m)} if norm else out

    @classmethod
    def random(cls, inputs: int = WORDS, hidden: int = 32, layers: int = 10, seed: int = 42) -> ResidualNetwork:
        rng = np.random.default_rng(seed)
        blocks = [(cls._layer(rng, hidden, hidden), cls._layer(rng, hidden, hidden)) for _ in range(layers - 2)]
        return cls(cls._layer(rng, inputs, hidden), blocks, cls._layer(rng, hidden, 1, norm=False))

    def save(self, file) -> None:
        """Writes the weights as an .npz file (a path or a binary file)."""
        layers = {"first": self.first, "last": self.last} | {f"block{i}{side}": layer for i, pair in enumerate(self.blocks) for side, layer in zip("ab", pair)}
        np.savez(file, **{f"{name}.{k}": v for name, layer in layers.items() for k, v in layer.items()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ResidualNetwork:
        """Reads weights that save() wrote, from any file system that Spark knows."""
        body = spark.read.format("binaryFile").load(path).select("content").first().content
        arrays = np.load(io.BytesIO(bytes(body)), allow_pickle=False)
        layers: dict[str, dict] = {}
        for key in arrays.files:
            name, k = key.rsplit(".", 1)
            layers.setdefault(name, {})[k] = arrays[key]
        many = sum(name.startswith("block") for name in layers) // 2
        return cls(layers["first"], [(layers[f"block{i}a"], layers[f"block{i}b"]) for i in range(many)], layers["last"])

    @staticmethod
    def _apply(x: np.ndarray, layer: dict) -> np.ndarray:
        x = x @ layer["w"] + layer["b"]
        if "gain" in layer:
            x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * layer["gain"] + layer["shift"]
        return x

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.maximum(self._apply(x, self.first), 0)
        for a, b in self.blocks:
            x = np.maximum(self._apply(np.maximum(self._apply(x, a), 0), b) + x, 0)
        return self._apply(x, self.last)[:, 0]


def scored(network: ResidualNetwork, ids: pd.Series) -> np.ndarray:
    """The network's values for texts given by the buckets of their words; SCORED texts are a dense matrix at a time, however large the batch is."""
    out = [np.zeros(0)]
    for begin in range(0, len(ids), SCORED):
        some = ids.iloc[begin : begin + SCORED]
        x = np.zeros((len(some), len(network.first["w"])))
        for i, at in enumerate(some):
            if at is not None and len(at):
                x[i, np.asarray(at, np.int64)] = 1 / np.sqrt(len(at))
        out.append(network(x))
    return np.concatenate(out)


def network_scorer(network: ResidualNetwork, text: str, out: str, buckets: Callable[[Column, int], Column] = word_buckets) -> Scorer:
    """Prices by a network over hashed words (by the hash it was trained with). Weights are broadcast; each worker holds one copy for all its batches."""

    def score(df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(network)

        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            own = sent.value
            for ids in batches:
                yield pd.Series(scored(own, ids))

        predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        udf = F.pandas_udf(predict, "double")
        return df.withColumn(out, from_target(udf(buckets(F.col(text), len(network.first["w"])))))

    return score


def ensemble_scorer(frontier: Scorer, specialist: Scorer, network: Scorer, out: str = "estimate") -> Scorer:
    """The weighted combination of three scorers, which write the columns frontier, specialist and network."""
    return lambda df: network(specialist(frontier(df))).withColumn(out, ensemble(F.col("frontier"), F.col("specialist"), F.col("network")))


def rewritten(text: Column, n: int = 500) -> Column:
    """A text in the place of its rewrite by a language model: white space made even, at most n characters."""
    return cut(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), n)


def message(description: Column, price: Column, estimate: Column) -> Column:
    """An alert in the place of one that a language model writes."""
    return F.concat(F.lit("Great deal: "), description, F.lit(" Offered at $"), F.replace(F.format_number(price, 2), F.lit(","), F.lit("")), F.lit(", worth $"), F.replace(F.format_number(estimate, 2), F.lit(","), F.lit("")), F.lit("."))


def embedded(text: Column, width: int = 64) -> Column:
    """A seeded projection of hashed words on the unit sphere, in the place of a sentence encoder. Arrow batches."""

    def of(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(width)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % width] += 1.0 if h >> 16 & 1 else -1.0
            out.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32).tolist())
        return pd.Series(out)

    return F.pandas_udf(of, "array<float>")(text)


def generated(prompt: Column, load: Callable[[], Callable[[list[str]], list[str]]] = lambda: first_words) -> Column:
    """A text-to-text model on a column of prompts. load gives its function from prompts to answers, once a worker task; the default is a stand-in."""

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            given = prompts[prompts.notna()]
            out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
            out[given.index] = model(given.tolist())
            yield out

    answer.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(answer, "string")(prompt)


def first_words(prompts: list[str], n: int = 5) -> list[str]:
    """In the place of a language model that goes on for n tokens: the prompt and its own first words."""
    return [" ".join([p, *p.split()[:n]]) for p in prompts]


def usage_totals(calls: DataFrame) -> DataFrame:
    """Sums of tokens and cost over calls. Sums, not accumulators: retried tasks would count twice there."""
    return calls.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.count("*").alias("calls"))
