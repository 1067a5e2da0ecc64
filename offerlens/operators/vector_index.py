"""Approximate nearest neighbours by an inverted index: coarse lists, product codes of residuals, exact distances of a short list.

train() fits the centres of lists by distributed k-means and, for what is left of a vector after its centre, a codebook a part. build() puts every
vector into the list of its nearest centre and stores its codes beside it, in files ordered by list. search() sends each query to the
lists of its nearest centres; there, sums over a table of distances to the codebooks' entries pick a short list, whose exact distances decide.
calibrated() measures on queries of the corpus how many lists hold their true neighbours, and sets the number of lists accordingly.

No list meets a task whole: lists are cut into blocks of BLOCK_ROWS vectors, and the queries of a list into blocks of QUERY_ROWS. Equal vectors are one entry with
their `copies` smallest ids, as ties go to smaller ids: an entry never leaves out an id that could be among the k <= copies nearest. Equal queries are searched once.

Model: at most MOST_LISTS centres and 256 entries a part, fitted on at most SAMPLE_ROWS vectors with the smallest hash of their id;
that is what is broadcast and what comes to the driver. Null vectors and ids, vectors with null or non-finite components and vectors of another width than
the model's are not indexed and not searched. An empty corpus has an index without lists; searching it finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .similarity import nearest

#: Vectors that a model is fitted on, at most.
SAMPLE_ROWS = 262_144
#: Bound of the number of lists; it grows with the square root of the corpus until then.
MOST_LISTS = 16_384
BLOCK_ROWS = 8192
#: Sums of centres or entries that one task adds up.
SLOTS = 512
QUERY_ROWS = 1024
#: Queries that calibrated() compares with exact neighbours, at most.
TRIALS = 512
_SEED = 17


@dataclass(frozen=True)
class Model:
    centres: np.ndarray  # (lists, width) float32
    books: np.ndarray  # (parts, entries, width of a part) float32
    probes: int = 8

    @property
    def width(self) -> int:
        return self.centres.shape[1]


@dataclass(frozen=True)
class Index:
    model: Model
    path: str
    copies: int


def usable(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """(id, embedding as floats) of the rows that can be compared."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where("id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('infinity'))")
    return rows.where(F.size("embedding") == width) if width is not None else rows


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)


def _padded(x: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width of a part), filled with zeros."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    return x.reshape(len(x), parts, -1)


def _lloyd(sample: DataFrame, begun: np.ndarray, prepare, rounds: int, blocks: int) -> np.ndarray:
    """k-means over a table (embedding): begun is (blocks, k, w), prepare(x) gives (rows, blocks, w). Tasks add up their rows; sums meet in one shuffle by entry."""
    at = begun.astype(np.float32)
    k, w = at.shape[1:]
    for _ in range(rounds):
        sent = sample.sparkSession.sparkContext.broadcast(at)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((blocks, k, w + 1))
            for batch in batches:
                own, x = sent.value, prepare(_rows(batch.column(0), batch.column(0).value_lengths()[0].as_py())) if batch.num_rows else ([], None)
                for b in range(blocks if batch.num_rows else 0):
                    near = _squares(x[:, b], own[b]).argmin(1)
                    order = np.argsort(near, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(near[order]) != 0])
                    total[b, near[order][first], 1:] += np.add.reduceat(x[order, b].astype(np.float64), first, axis=0)
                    total[b, :, 0] += np.bincount(near, minlength=k)
            flat = total.reshape(blocks * k, w + 1)
            used = np.flatnonzero(flat[:, 0])
            part = np.full(len(used), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(part), pa.array(flat[used, 0]), pa.array(list(flat[used, 1:]), pa.list_(pa.float64()))], names=["slot", "part", "n", "sums"])

        def added(table: pa.Table) -> pa.Table:
            """Sums by slot in the order of the parts. A block has many slots, so that few groups go through Python."""
            slot, part = table.column("slot").to_numpy(), table.column("part").to_numpy()
            order = np.lexsort((part, slot))
            slot = slot[order]
            first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            sums = table.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)[order]
            n = np.add.reduceat(table.column("n").to_numpy()[order], first)
            return pa.table({"slot": slot[first], "n": n, "sums": pa.array(list(np.add.reduceat(sums, first, axis=0)), pa.list_(pa.float64()))})

        partial = sample.mapInArrow(run, "slot long, part int, n double, sums array<double>")
        found = partial.groupBy((F.col("slot") / SLOTS).cast("int").alias("block")).applyInArrow(added, "slot long, n double, sums array<double>").collect()
        sent.unpersist()
        new = at.copy().reshape(blocks * k, w)
        for r in found:
            new[r.slot] = np.asarray(r.sums) / r.n
        at = new.reshape(blocks, k, w)
    return at


def train(corpus: DataFrame, path: str, lists: int | None = None, parts: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> Model | None:
    """A model for corpus(id, embedding), or None without vectors. path: a folder that executors share, for the sample. Centres begin at the sample's first distinct vectors."""
    rows = usable(corpus)
    first = rows.select(F.size("embedding").alias("w"), F.xxhash64(F.lit(_SEED), "id").alias("p"), "id").orderBy("p", "id").first()
    if first is None or not first.w:
        return None
    width = first.w
    rows = rows.where(F.size("embedding") == width)
    count = rows.count()
    place = F.xxhash64(F.lit(_SEED), "id")
    # a limit leaves one part, which one task would fit alone
    dealt = rows.withColumn("place", place).orderBy("place", "id").limit(sample_rows).repartition(corpus.sparkSession.sparkContext.defaultParallelism, "place")
    dealt.sortWithinPartitions("place", "id").write.parquet(f"{path}/sample")
    sample = corpus.sparkSession.read.parquet(f"{path}/sample")
    lists = lists or int(min(MOST_LISTS, max(1, round(count**0.5)), max(1, min(count, sample_rows) // 16)))
    start = sample.dropDuplicates(["embedding"]).orderBy("place", "id").limit(max(lists, 256)).select("embedding").toArrow().column(0).combine_chunks()
    begun = _rows(start, width)
    centres = _lloyd(sample.select("embedding"), begun[None, :lists], lambda x: x[:, None, :], rounds, 1)[0]
    parts = parts or max(1, -(-width // 4))
    sent = centres

    def residual(x: np.ndarray) -> np.ndarray:
        return _padded(x - sent[_squares(x, sent).argmin(1)], parts)

    entries = residual(begun[:256]).transpose(1, 0, 2)
    return Model(centres, _lloyd(sample.select("embedding"), entries, residual, rounds, parts))


def _key() -> list[Column]:
    return [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(_SEED), "embedding").alias("h2")]


def build(corpus: DataFrame, model: Model, path: str, copies: int = 16, mode: str = "overwrite") -> Index:
    """Indexes every usable row of corpus(id, embedding) below path. mode "append" adds to an index that is there.

    Equal vectors (by 128 bits of hash) become one entry: each task first keeps the `copies` smallest ids it has of a vector.
    """
    sent = corpus.sparkSession.sparkContext.broadcast(model)
    keyed = usable(corpus, model.width).select("id", "embedding", *_key())
    least = keyed.withColumn("rn", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("rn") <= copies)
    entries = least.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("embedding").alias("embedding"))  # at most `copies` rows a group

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(1), own.width)
                at = _squares(x, own.centres).argmin(1)
                cut = _padded(x - own.centres[at], len(own.books))
                codes = np.stack([_squares(cut[:, p], own.books[p]).argmin(1) for p in range(len(own.books))], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "ids", "embedding", "codes"])

    rows = entries.select("ids", "embedding").mapInArrow(encode, "list int, ids array<long>, embedding array<float>, codes binary")
    order = ["list", F.col("ids")[0]]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(f"{path}/lists")
    save(corpus.sparkSession, model, path, copies)
    return Index(model, path, copies)


def save(spark: SparkSession, model: Model, path: str, copies: int) -> None:
    vectors = lambda kind, m: [(kind, i, [float(v) for v in row]) for i, row in enumerate(m)]
    parts, entries, w = model.books.shape
    rows = vectors("centre", model.centres) + vectors("entry", model.books.reshape(-1, w)) + [("shape", 0, [float(parts), float(entries), float(model.probes), float(copies)])]
    spark.createDataFrame(rows, "kind string, number int, vector array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that build() has written."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "number").collect()
    take = lambda kind: np.array([r.vector for r in rows if r.kind == kind], np.float32)
    parts, entries, probes, copies = (int(v) for v in take("shape")[0])
    return Index(Model(take("centre"), take("entry").reshape(parts, entries, -1), probes), path, copies)


def _probed(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """(query, embedding, list, nth): the lists of a query's nearest centres."""
    sent = queries.sparkSession.sparkContext.broadcast(model.centres)
    many = min(probes, len(model.centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _squares(_rows(batch.column(1), sent.value.shape[1]), sent.value)
                near = np.argsort(d, axis=1, kind="stable")[:, :many]
                at = pa.array(np.repeat(np.arange(batch.num_rows), many))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(many, dtype=np.int32), batch.num_rows))], names=["query", "embedding", "list", "nth"])

    return queries.mapInArrow(run, "query long, embedding array<float>, list int, nth int")


def search(index: Index, queries: DataFrame, k: int = 5, probes: int | None = None, short: int = 64, digits: int = 9, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest found for each of queries(id, embedding), as similarity.nearest() gives them exactly. short: rows a block whose exact distances are computed."""
    if k > index.copies:
        raise ValueError(f"the index keeps {index.copies} ids of equal vectors: build it with copies={k}")
    spark, model = queries.sparkSession, index.model
    asked = usable(queries, model.width).select("id", "embedding", *_key())
    one = asked.groupBy("h1", "h2").agg(F.min("id").alias("query"), F.first("embedding").alias("embedding")).select("query", "embedding", "h1", "h2")
    entries = spark.read.parquet(f"{index.path}/lists")
    # at most MOST_LISTS rows each: how many blocks of vectors and of queries a list has
    blocks = lambda df, size: F.broadcast(df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")))
    probed = _probed(one.select("query", "embedding"), model, probes or model.probes)
    deal = lambda n, salt, c: F.pmod(F.xxhash64(F.lit(salt), c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    of_lists, of_queries = blocks(entries, block_rows).withColumnRenamed("blocks", "cuts"), blocks(probed, query_rows)
    left = probed.join(of_queries, "list").join(of_lists, "list").select("query", "embedding", "list", deal(F.col("blocks"), 1, "query").alias("qblock"), every(F.col("cuts")).alias("block"))
    right = entries.join(of_queries, "list").join(of_lists, "list").select("ids", "embedding", "codes", "list", deal(F.col("cuts"), 2, F.col("ids")[0]).alias("block"), every(F.col("blocks")).alias("qblock"))
    sent = spark.sparkContext.broadcast(model)
    schema = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("distance", pa.float64())])

    def meet(asked_t: pa.Table, given_t: pa.Table) -> pa.Table:
        own = sent.value
        if not asked_t.num_rows or not given_t.num_rows:
            return schema.empty_table()
        asked_t, given_t = asked_t.combine_chunks(), given_t.combine_chunks()
        q, x = (_rows(t.column("embedding").chunk(0), own.width) for t in (asked_t, given_t))
        codes = np.frombuffer(b"".join(given_t.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        cut = _padded(q - own.centres[asked_t.column("list")[0].as_py()], len(own.books))
        n = min(max(short, 4 * k), len(x))
        near = np.zeros((len(q), len(x)), np.float32)
        for p in range(len(own.books)):
            near += _squares(cut[:, p], own.books[p])[:, codes[:, p]]
        picked = np.argpartition(near, n - 1, axis=1)[:, :n] if n < len(x) else np.tile(np.arange(n), (len(q), 1))
        who = np.repeat(np.arange(len(q)), n)
        gap = q[who].astype(np.float64) - x[picked.ravel()].astype(np.float64)
        distance = np.round(np.sqrt((gap * gap).sum(1)), digits).reshape(len(q), n)
        least = np.array([i[0] for i in given_t.column("ids").to_pylist()])
        top = np.lexsort((least[picked], distance), axis=1)[:, :k]
        rows = np.arange(len(q))[:, None]
        return pa.Table.from_arrays([asked_t.column("query").take(pa.array(np.repeat(np.arange(len(q)), top.shape[1]))), given_t.column("ids").take(pa.array(picked[rows, top].ravel())), pa.array(distance[rows, top].ravel())], schema=schema)

    key = ["list", "block", "qblock"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query long, ids array<long>, distance double")
    best = Window.partitionBy("query").orderBy("distance", "id")
    # entries of equal distance may interleave by id, so ids are ranked, not entries
    ranked = found.select("query", F.explode("ids").alias("id"), "distance").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    whose = asked.select(F.col("id").alias("query_id"), "h1", "h2")
    answers = ranked.join(one.select("query", "h1", "h2"), "query").groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))).alias("near"))  # k rows a query
    return whose.join(answers, ["h1", "h2"]).select("query_id", F.explode("near").alias("n")).select("query_id", "n.id", "n.distance", "n.rank")


def calibrated(index: Index, corpus: DataFrame, k: int = 5, target: float = 0.95, trials: int = TRIALS) -> Index:
    """The index with the number of probes after which at least `target` of the true neighbours' lists have been met, on up to `trials` vectors of the corpus, and saved so."""
    spark, model = corpus.sparkSession, index.model
    rows = usable(corpus, model.width)
    asked = rows.orderBy(F.xxhash64(F.lit(_SEED + 1), "id"), "id").limit(trials)
    true = nearest(rows, asked, k).select("query_id", "id")
    lists = spark.read.parquet(f"{index.path}/lists").select("list", F.explode("ids").alias("id")).join(F.broadcast(true), "id")  # trials * k rows
    order = _probed(asked.select(F.col("id").alias("query"), "embedding"), model, len(model.centres)).select(F.col("query").alias("query_id"), "list", "nth")
    ranks = sorted(r.nth for r in order.join(F.broadcast(lists.select("query_id", "list")), ["query_id", "list"]).select("nth").collect())
    probes = ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)] + 1 if ranks else 1
    out = replace(index, model=replace(model, probes=int(probes)))
    save(spark, out.model, index.path, index.copies)
    return out


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, neighbours that the exact search has, and the share of them that `found` has at the same distance or the same id."""
    reach = exact.groupBy("query_id").agg(F.max("distance").alias("reach"), F.count("*").alias("k"))
    hits = found.join(reach, "query_id", "right").groupBy("query_id").agg(F.first("k").alias("k"), F.count(F.when(F.col("distance") <= F.col("reach"), 1)).alias("hit"))
    return hits.agg(F.count("*").alias("queries"), F.coalesce(F.sum("k"), F.lit(0)).alias("neighbours"), F.try_divide(F.sum("hit"), F.sum("k")).alias("recall"))
