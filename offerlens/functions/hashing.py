"""Hashed words as other libraries hash them: MurmurHash3 of 32 bits over UTF-8, over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of MurmurHash3, x86, 32 bits.
C1, C2, ADD, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
#: Words of more bytes are hashed one by one, so that a batch never steps as often as its longest word needs.
LONG = 256


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def murmur3(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """Signed 32-bit hashes of spans of bytes, all words a block at a time."""
    h = np.full(len(start), seed, np.uint32)
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    blocks = size // 4
    with np.errstate(over="ignore"):
        at = np.flatnonzero(blocks > 0)
        step = 0
        while len(at):
            place = start[at] + 4 * step
            k = sum(padded[place + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
            h[at] = _rotated(h[at] ^ (_rotated(k * np.uint32(C1), 15) * np.uint32(C2)), 13) * np.uint32(5) + np.uint32(ADD)
            step += 1
            at = at[blocks[at] > step]
        rest, place = size % 4, start + 4 * blocks
        k = np.zeros(len(start), np.uint32)
        for i in range(3):
            own = rest > i
            k[own] ^= padded[place[own] + i].astype(np.uint32) << np.uint32(8 * i)
        h ^= _rotated(k * np.uint32(C1), 15) * np.uint32(C2)
        h ^= size.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(MIX1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(MIX2)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """Signed 32-bit hashes of an Arrow column of strings without nulls."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.int32)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    start, size = bounds[:-1], np.diff(bounds)
    out = np.zeros(len(words), np.int32)
    short = size <= LONG
    out[short] = murmur3(data, start[short], size[short], seed)
    for i in np.flatnonzero(~short):
        out[i] = murmur3(data[start[i] : start[i] + size[i]], np.zeros(1, np.int64), size[i : i + 1], seed)[0]
    return out


def murmur_buckets(words: Column, n: int, seed: int = 0) -> Column:
    """The distinct buckets of a column of arrays of words, ascending: the absolute value of the signed hash, modulo n. A null array and null words count as none."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            lists = pa.array(batch, pa.list_(pa.string()))
            row, flat = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten()
            at = np.abs(hashes(flat, seed).astype(np.int64)) % n
            pair = np.unique(row * n + at)
            yield pd.Series(np.split(pair % n, np.searchsorted(pair // n, np.arange(1, len(lists)))) if len(lists) else [], dtype=object)

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(of, "array<int>")(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w.isNotNull()))
