"""What the training-data operators share: tables, cuts of lineage, checked joins and a vectorised tokeniser."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token of every word-based contract.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a lookup side that may be broadcast, by what a row may hold.
BROADCAST_ROWS = 500_000
#: Rows of a table in one file, where the most it can have is known.
FILE_ROWS = 20_000
#: A key with at least this share of all rows is dealt with by broadcast, so there are at most 1/HOT_SHARE such keys.
HOT_SHARE = 1 / 5000
#: Bytes of an Arrow batch that Spark sends to a Python task, and the row that ends it. Less than a part of slices(), so a batch is one part.
BATCH_BYTES = 2 << 20

_made: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_BYTES at most, besides 10,000 rows: those of long texts would fill the executors' memory.

    Spark reads this when a plan is executed, so it stays set; a lower value of the user's stays too.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)[a-z]*\s*", spark.conf.get(name).lower()).groups()
    if int(number) << 10 * "bkmgtp".index(unit or "b") > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='offerlens-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """Cuts the lineage: writes a table in the shared folder and reads it again. Survives lost executors.

    rows: the most that it can have, if its last step follows a shuffle; then tasks for `each` rows write it, and not one for each partition of the shuffle.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(max(1, -(-rows // each)))
    bound_batches(spark)
    path = f"{shared_dir(spark)}/offerlens/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._offerlens_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing will read again: what was made from them must have been written."""
    for table in tables:
        _delete(table.sparkSession, table._offerlens_path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done: its cleaner acts once the driver's JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Deletes what materialize() has written; results that still read it must have been used."""
    for session, path in list(_made):
        if session is spark:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _made[:] = [(s, p) for s, p in _made if p != path]
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    for session in {id(s): s for s, _ in _made}.values():
        try:
            release(session)
        except Exception:  # noqa: BLE001  the JVM may have gone
            return


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the value as text, mod n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a narrow lookup. It is broadcast only if it has at most `most` rows (counted, unless given); beyond that both sides are shuffled."""
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows <= most else right.hint("merge"), on, how)


def join_hot(left: DataFrame, lookup: DataFrame, on: str, weight: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """left left-joined with lookup (one row a key; weight: rows of left with that key), with no key's rows in one task.

    Keys with at least share*total rows are at most 1/share by construction; they are broadcast. The others are
    shuffled, and none of them has more than share*total rows. Both inputs should be materialised: left is read twice.
    """
    least = max(2, int(total * share))
    hot, cold = lookup.where(F.col(weight) >= least), lookup.where(F.col(weight) < least)
    value = [c for c in lookup.columns if c != on]
    flagged = left.join(F.broadcast(hot.withColumn("__hot", F.lit(1))), on, "left")
    rest = flagged.where(F.col("__hot").isNull()).select(*left.columns)
    return flagged.where(F.col("__hot").isNotNull()).select(*left.columns, *value).unionByName(rest.join(cold, on, "left").select(*left.columns, *value))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[name] = np.multiply.accumulate(p)
    return have[:n]


def tokens(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and 64-bit hash of each word in a batch of texts.

    data: the UTF-8 bytes of all texts in a row; bounds: where each text begins, and the end. Words are WORD; a text's
    border also ends a word. Hashes are a polynomial in the bytes' random values, then mixed; equal words have equal hashes.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    letter = ~_SPACE[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = bounds[:-1][bounds[:-1] < n]
    first[inner] = letter[inner]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    ends = bounds[1:][bounds[1:] > 0] - 1
    last[ends] = letter[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    return start, end, doc, span_hash(data, start, end, lower)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True, block: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):  # blocks keep the powers and sums in cache
            j = max(i + 1, int(np.searchsorted(end, start[i] + block, side="right")))
            lo, hi = int(start[i]), int(end[j - 1])
            part = data[lo:hi]
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[_LOWER[part] if lower else part] * _power(_BASE, "up", hi - lo), out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix64((sums[e] - sums[s]) * _power(_INVERSE, "down", hi - lo)[s] + (e - s).astype(np.uint64))
            i = j
    return out


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow column of strings; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch, most: int = 4 << 20):
    """An Arrow batch in parts of about `most` bytes, so that what is made from one stays small. A very long row is a part of its own."""
    size, at, begun = batch.num_rows, 0, 0
    if not size:
        return
    each = max(1, batch.nbytes // size)
    step = max(1, most // each)
    while begun < size:
        at = min(size, begun + step)
        yield batch.slice(begun, at - begun)
        begun = at
