"""Vectors in a few dimensions for a plot, by t-distributed stochastic neighbour embedding.

At most LANDMARKS distinct vectors, those with the smallest hash of their smallest id, are embedded: an exact graph of nearest neighbours, per vector a width
of its Gaussian by bisection so that the perplexity is met, symmetric affinities as a table in a shared folder. In each step
the positions (a few numbers a landmark, bounded by LANDMARKS) are broadcast; tasks compute the forces on their own landmarks, attraction along the graph and repulsion over
an octree of all positions (a cell stands for its points where it is small against its distance); the driver moves the positions.
Every other vector is placed among its nearest landmarks, weighted by 1 / distance, an equal one where that landmark is.

Positions begin at seeded random places and every sum has a fixed order, so a rerun gives equal rows, however tasks are dealt. Null ids and vectors, null or
non-finite components and vectors of another width than that of the smallest id are left out. With fewer than two distinct vectors every position is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import nearest
from .vector_index import usable

#: Vectors that are embedded themselves; the reference data of a plot have this many.
LANDMARKS = 2000
DIMENSIONS = 3
_ROWS = "i long, others array<int>, shares array<double>"


def bisected(squares: np.ndarray, perplexity: float) -> np.ndarray:
    """Per row of squared distances to neighbours, the probabilities of a Gaussian whose perplexity is met."""
    n = len(squares)
    lo, hi, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    target = np.log(perplexity)
    squares = squares - squares.min(1, keepdims=True)
    scale = np.maximum(squares.mean(1, keepdims=True), 1e-300)
    squares = squares / scale
    for _ in range(64):
        p = np.exp(-squares * beta[:, None])
        total = p.sum(1)
        entropy = np.log(total) + beta * (p * squares).sum(1) / total
        high = entropy > target
        lo, hi = np.where(high, beta, lo), np.where(high, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + np.minimum(hi, 1e300)) / 2)
    return p / p.sum(1, keepdims=True)


class Octree:
    """Cells of positions at every level, by Morton order: how many points each has, their centre, and its children in the next level."""

    def __init__(self, y: np.ndarray, depth: int = 14):
        low, self.side = y.min(0), max(float((y.max(0) - y.min(0)).max()), 1e-12) * (1 + 1e-9)
        grid = np.minimum(((y - low) / self.side * (1 << depth)).astype(np.int64), (1 << depth) - 1)
        code = np.zeros(len(y), np.int64)
        for bit in range(depth):
            for axis in range(y.shape[1]):
                code |= ((grid[:, axis] >> bit) & 1) << (bit * y.shape[1] + axis)
        order = np.argsort(code, kind="stable")
        code, own = code[order], y[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # points, centre, first child, children
        starts = [np.flatnonzero(np.r_[True, (c := code >> ((depth - level) * y.shape[1]))[1:] != c[:-1]]) for level in range(depth + 1)]
        for level, at in enumerate(starts):
            n = np.diff(np.r_[at, len(y)])
            centre = np.add.reduceat(own, at, axis=0) / n[:, None]
            below = starts[level + 1] if level < depth else at
            first = np.searchsorted(below, at)
            self.levels.append((n, centre, first, np.diff(np.r_[first, len(below)])))
            if level and len(at) == len(y):
                break

    def repulsion(self, points: np.ndarray, angle: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
        """Per point, the sum of q and of q^2 * (point - other) over all positions, q = 1 / (1 + squared distance). A point's own position adds 1 to the first."""
        z, force = np.zeros(len(points)), np.zeros_like(points)
        who, cell = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level, (n, centre, first, children) in enumerate(self.levels):
            gap = points[who] - centre[cell]
            square = (gap * gap).sum(1)
            side = self.side / (1 << level)
            done = (side * side < angle * angle * square) | (n[cell] == 1) | (level == len(self.levels) - 1)
            w, q = who[done], 1 / (1 + square[done])
            many = n[cell[done]] * q
            z += np.bincount(w, many, len(points))
            for axis in range(points.shape[1]):
                force[:, axis] += np.bincount(w, many * q * gap[done, axis], len(points))
            who, cell = who[~done], cell[~done]
            if not len(who):
                break
            k = children[cell]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            who, cell = np.repeat(who, k), np.repeat(first[cell], k) + at
        return z, force


def _affinities(landmarks: DataFrame, perplexity: float, n: int, path: str) -> DataFrame:
    """(i, others, shares): the symmetric affinities of each landmark, in order of the other."""
    k = int(min(n - 1, max(1, 3 * perplexity)))
    near = nearest(landmarks, landmarks, k + 1).where("query_id != id")
    rows = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))  # k rows a landmark
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("p", pa.float64())])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = bisected(np.array([[f["distance"] ** 2 for f in found]]), min(perplexity, len(found)))[0]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(p)), pa.array([f["id"] for f in found]), pa.array(p)], schema=schema)

    one = rows.mapInArrow(shares, "i long, j long, p double")
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "p")).groupBy("i", "j").agg((F.sum("p") / (2 * n)).alias("p"))
    listed = both.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "p"))).alias("all"))
    listed.select("i", F.col("all.j").cast("array<int>").alias("others"), F.col("all.p").alias("shares")).repartitionByRange("i").write.parquet(f"{path}/affinities")
    return landmarks.sparkSession.read.schema(_ROWS).parquet(f"{path}/affinities")


def _forces(graph: DataFrame, y: np.ndarray, exaggeration: float, angle: float) -> np.ndarray:
    """The gradient at positions y: one job."""
    sent = graph.sparkSession.sparkContext.broadcast(y)
    d = y.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            if not batch.num_rows:
                continue
            every = sent.value
            tree = tree or Octree(every)
            i = batch.column(0).to_numpy()
            own = every[i]
            z, push = tree.repulsion(own, angle)
            n = batch.column(1).value_lengths().to_numpy()
            others, p = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            gap = np.repeat(own, n, axis=0) - every[others]
            pull = np.add.reduceat(gap * (p / (1 + (gap * gap).sum(1)))[:, None], np.cumsum(n) - n, axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z - 1), *(pa.array(m[:, a]) for m in (pull, push) for a in range(d))], names=["i", "z", *(f"{m}{a}" for m in ("pull", "push") for a in range(d))])

    kinds = "i long, z double, " + ", ".join(f"{m}{a} double" for m in ("pull", "push") for a in range(d))
    table = graph.mapInArrow(run, kinds).toArrow()
    sent.unpersist()
    order = np.argsort(table.column("i").to_numpy())
    columns = [table.column(c).to_numpy()[order] for c in table.column_names[1:]]
    pull, push = np.stack(columns[1 : 1 + d], 1), np.stack(columns[1 + d :], 1)
    return 4 * (exaggeration * pull - push / max(columns[0].sum(), 1e-300))


def embedded_landmarks(landmarks: DataFrame, n: int, path: str, perplexity: float = 30.0, dimensions: int = DIMENSIONS, steps: int = 250, angle: float = 0.5, seed: int = 42) -> np.ndarray:
    """Positions of landmarks(id, embedding) whose ids are 0 to n - 1."""
    if n < 2:
        return np.zeros((n, dimensions))
    graph = _affinities(landmarks, min(perplexity, max(1.0, (n - 1) / 3)), n, path)
    graph = graph.repartition(landmarks.sparkSession.sparkContext.defaultParallelism, "i").persist()  # read in every step; a lost part is read from the table again
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, dimensions))
    speed, gains, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50.0)
    for step in range(steps):
        early = step < steps // 4
        slope = _forces(graph, y, 12.0 if early else 1.0, angle)
        gains = np.maximum(np.where(np.sign(slope) == np.sign(speed), gains * 0.8, gains + 0.2), 0.01)
        speed = (0.5 if early else 0.8) * speed - rate * gains * slope
        y = y + speed
        y = y - y.mean(0)
    graph.unpersist()
    return y


def placed(vectors: DataFrame, marks: np.ndarray, positions: np.ndarray, near: int = 5) -> DataFrame:
    """vectors(id, embedding) with their position among the landmarks' (both are broadcast)."""
    sent = vectors.sparkSession.sparkContext.broadcast((marks.astype(np.float64), positions))
    width = positions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = sent.value
        for batch in batches:
            for begun in range(0, batch.num_rows, 4096):
                part = batch.slice(begun, 4096)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, known.shape[1])
                square = np.maximum((x * x).sum(1)[:, None] + (known * known).sum(1)[None] - 2 * x @ known.T, 0)
                best = np.argsort(square, axis=1, kind="stable")[:, :near]
                gap = np.sqrt(((x[:, None, :] - known[best]) ** 2).sum(2))
                same = gap.min(1) == 0
                weight = np.where(same[:, None], gap == 0, 1 / np.maximum(gap, 1e-300))
                y = (weight[:, :, None] * at[best]).sum(1) / weight.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["id", "position"])

    assert width
    return vectors.select("id", "embedding").mapInArrow(run, "id long, position array<double>")


def tsne(vectors: DataFrame, path: str, landmarks: int = LANDMARKS, **how) -> DataFrame:
    """(id, position) of every usable row of vectors(id, embedding). path: a new folder that executors share."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    first = rows.orderBy("id", "embedding").select(F.size("embedding")).first()
    if first is None or not first[0]:
        return rows.select("id", F.array_repeat(F.lit(0.0), how.get("dimensions", DIMENSIONS)).alias("position"))
    rows = rows.where(F.size("embedding") == first[0])
    chosen = rows.groupBy("embedding").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id", "embedding").limit(landmarks).toArrow()
    marks = chosen.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(chosen.num_rows, -1)
    table = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(marks)], "id long, embedding array<float>")
    table.write.parquet(f"{path}/landmarks")
    positions = embedded_landmarks(spark.read.parquet(f"{path}/landmarks"), len(marks), path, **how)
    return placed(rows, marks, positions)


def preserved(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """One row: the mean share of a vector's k nearest neighbours in before(id, embedding) that after(id, embedding) has too. For the landmarks of a plot: both are compared exactly."""
    near = lambda df: nearest(df, df, k + 1).where("query_id != id").where(F.col("rank") <= k + 1).select("query_id", "id")
    kept = near(before).join(near(after), ["query_id", "id"]).count()
    return before.agg((F.lit(float(kept)) / (F.count("*") * k)).alias("preserved"))
