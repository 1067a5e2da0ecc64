"""Training of the residual network: gradients by tasks, summed by a tree, Adam on the driver.

Rows that are equal in words and price are one row with a weight; they are packed into chunks by a hash, each chunk one row of a table in a shared folder, so a step reads
its block of chunks without a shuffle and every sum has a fixed order: a rerun gives equal weights, however tasks are dealt. A step's gradients are
added in two levels (chunks by the root of their number, then those on the driver). The weights, which are broadcast in each step, and Adam's
two moments are bounded by MOST_WEIGHTS. Rows without a price are not learnt from; texts without words have all-zero features. Without rows the network stays as it began.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import to_target
from .scorers import ResidualNetwork

#: Numbers in a network, at most: 32 MB of doubles.
MOST_WEIGHTS = 4_000_000
CHUNK_ROWS = 2048
#: Rows that a step sees, about.
STEP_ROWS = 65_536
_CHUNK = "block int, chunk long, weights array<double>, labels array<double>, sizes array<int>, buckets array<int>"


def arrays(network: ResidualNetwork) -> list[np.ndarray]:
    """All weights, in a fixed order."""
    layers = [network.first, *(layer for pair in network.blocks for layer in pair), network.last]
    return [layer[k] for layer in layers for k in ("w", "b", "gain", "shift") if k in layer]


def with_arrays(network: ResidualNetwork, flat: np.ndarray) -> ResidualNetwork:
    """A network of the same shape with other weights."""
    at = 0

    def taken(layer: dict) -> dict:
        nonlocal at
        out = {}
        for k in ("w", "b", "gain", "shift"):
            if k in layer:
                out[k] = flat[at : at + layer[k].size].reshape(layer[k].shape)
                at += layer[k].size
        return out

    first = taken(network.first)
    blocks = [(taken(a), taken(b)) for a, b in network.blocks]
    return ResidualNetwork(first, blocks, taken(network.last))


def _norm(z: np.ndarray, layer: dict) -> tuple[np.ndarray, tuple]:
    spread = 1 / np.sqrt(z.var(1, keepdims=True) + 1e-5)
    hat = (z - z.mean(1, keepdims=True)) * spread
    return hat * layer["gain"] + layer["shift"], (hat, spread)


def _norm_back(g: np.ndarray, layer: dict, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hat, spread = kept
    inner = g * layer["gain"]
    return spread * (inner - inner.mean(1, keepdims=True) - hat * (inner * hat).mean(1, keepdims=True)), (g * hat).sum(0), g.sum(0)


def gradient(network: ResidualNetwork, sizes: np.ndarray, buckets: np.ndarray, labels: np.ndarray, weights: np.ndarray, dropout: float = 0.0, seed: int = 0) -> tuple[float, list[np.ndarray]]:
    """(sum of weighted squared errors / 2, its gradient as arrays() orders weights) over rows of binary words of length 1: buckets holds those of all rows one behind the other."""
    rng = np.random.default_rng(seed)
    mask = lambda shape: (rng.random(shape) >= dropout) / (1 - dropout) if dropout else 1.0
    row, scale = np.repeat(np.arange(len(sizes)), sizes), np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
    z = np.zeros((len(sizes), network.first["w"].shape[1]))
    used = sizes > 0
    if used.any():
        z[used] = np.add.reduceat(network.first["w"][buckets] * scale[:, None], (np.cumsum(sizes) - sizes)[used], axis=0)
    y, kept_first = _norm(z + network.first["b"], network.first)
    m_first = mask(y.shape)
    x = np.maximum(y, 0) * m_first
    trail = []
    for a, b in network.blocks:
        za, ka = _norm(x @ a["w"] + a["b"], a)
        ma = mask(za.shape)
        ha = np.maximum(za, 0) * ma
        zb, kb = _norm(ha @ b["w"] + b["b"], b)
        s = zb + x
        trail.append((x, za, ka, ma, ha, kb, s))
        x = np.maximum(s, 0)
    error = (x @ network.last["w"] + network.last["b"])[:, 0] - labels
    g = (weights * error)[:, None]
    out = [[x.T @ g, g.sum(0)]]
    g = g @ network.last["w"].T
    for (a, b), (x, za, ka, ma, ha, kb, s) in zip(reversed(network.blocks), reversed(trail)):
        g = g * (s > 0)
        gz, gain, shift = _norm_back(g, b, kb)
        out.append([ha.T @ gz, gz.sum(0), gain, shift])
        ga = (gz @ b["w"].T) * ma * (za > 0)
        gz, gain, shift = _norm_back(ga, a, ka)
        out.append([x.T @ gz, gz.sum(0), gain, shift])
        g = g + gz @ a["w"].T
    g = g * m_first * (y > 0)
    gz, gain, shift = _norm_back(g, network.first, kept_first)
    gw = np.zeros_like(network.first["w"])
    np.add.at(gw, buckets, gz[row] * scale[:, None])
    out.append([gw, gz.sum(0), gain, shift])
    return float((weights * error * error).sum() / 2), [m for layer in reversed(out) for m in layer]


def packed(known: DataFrame, buckets: Column, path: str, chunk_rows: int = CHUNK_ROWS, step_rows: int = STEP_ROWS) -> tuple[DataFrame, int]:
    """(chunks, blocks) of known(price, ...): a table with one row a chunk of about chunk_rows different rows, dealt over blocks of about step_rows."""
    rows = known.where("price is not null").select(to_target(F.col("price")).alias("label"), buckets.alias("b")).groupBy("b", "label").agg(F.count("*").cast("double").alias("weight"))
    rows.write.parquet(f"{path}/rows")
    rows = known.sparkSession.read.schema("b array<int>, label double, weight double").parquet(f"{path}/rows")
    count = rows.count()
    chunks = max(1, -(-count // chunk_rows))
    blocks = max(1, -(-count // step_rows))
    listed = rows.groupBy(F.pmod(F.xxhash64("b", "label"), F.lit(chunks)).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("label", "b", "weight"))).alias("r"))
    fields = [F.pmod("chunk", F.lit(blocks)).cast("int").alias("block"), "chunk", F.col("r.weight").alias("weights"), F.col("r.label").alias("labels"), F.transform("r.b", F.size).alias("sizes"), F.flatten("r.b").alias("buckets")]
    listed.select(*fields).write.partitionBy("block").parquet(f"{path}/chunks")
    return known.sparkSession.read.schema(_CHUNK).parquet(f"{path}/chunks"), blocks if count else 0


def _summed(chunks: DataFrame, network: ResidualNetwork, groups: int, dropout: float, seed: int) -> tuple[float, float, np.ndarray]:
    """(loss, weight, gradient) over chunks, added in the order of their numbers."""
    sent = chunks.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a chunk at a time
                chunk = batch.column("chunk")[i].as_py()
                weights, labels, sizes, buckets = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("weights", "labels", "sizes", "buckets"))
                loss, found = gradient(sent.value, sizes.astype(np.int64), buckets.astype(np.int64), labels, weights, dropout, seed * 1_000_003 + chunk)
                flat = np.concatenate([m.ravel() for m in found])
                yield pa.RecordBatch.from_arrays([pa.array([chunk % groups]), pa.array([chunk]), pa.array([loss]), pa.array([float(weights.sum())]), pa.array([flat.tobytes()], pa.binary())], names=["grp", "chunk", "loss", "weight", "flat"])

    def added(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("chunk").to_numpy())
        flats = table.column("flat")
        total = np.zeros(len(flats[0].as_py()) // 8)
        for i in order:
            total += np.frombuffer(flats[int(i)].as_py())
        sums = [float(table.column(c).to_numpy()[order].sum()) for c in ("loss", "weight")]
        return pa.table({"grp": table.column("grp")[:1], "chunk": table.column("chunk")[:1], "loss": sums[:1], "weight": sums[1:], "flat": pa.array([total.tobytes()], pa.binary())})

    schema = "grp long, chunk long, loss double, weight double, flat binary"
    rows = sorted(chunks.mapInArrow(run, schema).groupBy("grp").applyInArrow(added, schema).collect(), key=lambda r: r.grp)
    sent.unpersist()
    return sum(r.loss for r in rows), sum(r.weight for r in rows), sum(np.frombuffer(r.flat) for r in rows)


def trained(known: DataFrame, buckets: Column, network: ResidualNetwork, path: str, steps: int = 100, rate: float = 0.01, dropout: float = 0.0, decay: float = 1e-4, **how) -> tuple[ResidualNetwork, list[float]]:
    """(the network fitted to known(price, ...), the mean loss of each step). Adam with a rate that sinks along a cosine; decay pulls weights to 0."""
    flat = np.concatenate([m.ravel() for m in arrays(network)])
    if len(flat) > MOST_WEIGHTS:
        raise ValueError(f"a network of {len(flat)} weights is more than the driver may hold ({MOST_WEIGHTS})")
    chunks, blocks = packed(known, buckets, path, **how)
    if not blocks:
        return network, []
    many = chunks.groupBy("block").count().agg(F.max("count")).first()[0]
    groups = max(1, math.isqrt(many))
    chunks = chunks.persist()  # read in every step; lost parts are read from the table again
    first, second, losses = np.zeros_like(flat), np.zeros_like(flat), []
    for step in range(steps):
        own = chunks.where(F.col("block") == step % blocks) if blocks > 1 else chunks
        loss, weight, slope = _summed(own, with_arrays(network, flat), groups, dropout, step)
        slope = slope / max(weight, 1e-300)
        losses.append(loss / max(weight, 1e-300))
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        pace = rate * (1 + math.cos(math.pi * step / steps)) / 2
        flat = flat - pace * (first / (1 - 0.9 ** (step + 1)) / (np.sqrt(second / (1 - 0.999 ** (step + 1))) + 1e-8) + decay * flat)
    chunks.unpersist()
    return with_arrays(network, flat), losses
