"""A screen for a very large memory: a blocked Bloom filter, built by tasks, so that only possible hits are shuffled.

A key's hash chooses one block of 512 bits and eight bits in it, one in each of eight words. Blocks are put together by a bitwise or, which needs no order.
A key that the filter doesn't know was never surfaced and stays at once; the others meet the memory in a join, which decides.

Defined cases: a null key was never surfaced. Repeated keys set the same bits. An empty memory keeps every offer. The filter is
broadcast only if it has at most `most_blocks` blocks (64 bytes each); beyond it all keys are joined, which gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a block: 12 bits a key, some 1 % of unknown keys pass.
KEYS_A_BLOCK = 42
#: 64 MB of blocks (some 150 MB as rows of a broadcast), for 44 million keys.
MOST_BLOCKS = 1 << 20
WORDS = 8


@dataclass(frozen=True)
class Screen:
    """filter(block, w0 .. w7): a written table of n blocks, of those that have a key; keys: how many it was built for."""

    filter: DataFrame
    n: int
    keys: int


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(n))


def _bits(key: Column) -> list[Column]:
    """One bit of each word; a word's place is six bits of a second hash."""
    h = F.xxhash64(F.lit(2), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def build(memory: DataFrame, path: str, on: str = "url") -> Screen:
    """A screen of one version of the memory, written below path. One shuffle of blocks, combined before it."""
    keys = memory.select(on).where(F.col(on).isNotNull())
    count = keys.agg(F.approx_count_distinct(on, 0.02)).first()[0]
    n = max(1, -(-count // KEYS_A_BLOCK))
    bits = keys.select(_block(F.col(on), n).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(on)))))
    bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))).write.mode("overwrite").parquet(path)
    return Screen(memory.sparkSession.read.parquet(path), n, count)


def marked(offers: DataFrame, screen: Screen, on: str = "url") -> DataFrame:
    """offers with possible, whether the filter knows the key. Rows aren't shuffled: the filter's blocks are broadcast."""
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col(on))):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(bit) != 0)
    blocks = screen.filter.select(F.col("block").alias("__block"), *(F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)))
    joined = offers.withColumn("__block", F.when(F.col(on).isNotNull(), _block(F.col(on), screen.n))).join(F.broadcast(blocks), "__block", "left")
    return joined.withColumn("possible", F.coalesce(hit, F.lit(False))).select(*offers.columns, "possible")


def unseen(offers: DataFrame, memory: DataFrame, screen: Screen, on: str = "url", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Offers whose key was never surfaced, as planner.unseen gives them; only possible hits are joined. Repeated rows all stay."""
    keys = memory.select(F.col(on).alias("__key"))
    if screen.n > most_blocks:
        return offers.join(keys, F.col(on) == F.col("__key"), "left_anti")
    rows = marked(offers, screen, on)
    again = rows.where("possible").drop("possible").join(keys, F.col(on) == F.col("__key"), "left_anti")
    return rows.where("not possible").drop("possible").unionAll(again)


def passing(screen_keys: int, n: int) -> float:
    """The expected share of unknown keys that pass: the mean of (1 - (63/64)^k)^8 over blocks with Poisson many keys k."""
    mean, k = screen_keys / n, np.arange(400)
    logs = np.r_[0.0, np.cumsum(np.log(mean / np.arange(1, 400)))] if mean else np.r_[0.0, np.full(399, -np.inf)]
    return float((np.exp(logs - mean) * (1 - (63 / 64) ** k) ** WORDS).sum())
