"""Operator 13, product codes of vectors by Yinyang Lloyd rounds in integers.

A vector's components become integers floor(1024 * x); it is cut into PARTS equal consecutive parts, and each part has a
codebook of its own. A Lloyd round assigns every part to the nearest entry of its codebook and moves each entry to the
componentwise floor of its parts' mean. Entries of a codebook are clustered into groups once. Each row carries, per part, its
entry, an upper bound of the distance to it and one lower bound a group of the distance to the group's other entries. After
the entries have moved, the upper bound grows by its own entry's drift and each lower bound sinks by its group's
largest drift; a group is scanned only if its lower bound no longer lies above the upper one, which is made exact first.
Bounds are floating numbers rounded to the safe side, so a group that may hold an equal distance is always scanned, and
distances are compared as integers, ties going to the lower entry. The result is that of plain Lloyd rounds, exactly.

A round is one pass that writes rows with their bounds to the shared folder (the table of the round before is deleted), and
one that sums the parts by entry: tasks send at most PARTS * ENTRIES partial sums each, so neither a frequent vector nor a
frequent entry meets in one task. The codebooks (PARTS * ENTRIES entries) are all that comes to the driver.

Defined cases: rows whose vector is null or has null or non-finite components are dropped. The width is that of the vector of the smallest vec_id (of equal ones the smaller vector); rows of
another width are dropped, and a width that isn't a multiple of PARTS is filled with zeros. Integers are held within the range
in which squared distances fit 64 bits (components within about 185,000 at width 64). Rows with equal or null vec_ids are
coded each; null vec_ids come behind all others when the first entries are chosen, equal ones are ordered by vector. Fewer than
ENTRIES rows give as many entries. An empty table gives an empty result. Equal distances go to the lower entry; an entry without parts stays.
Extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize, read_table, slices

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Entries of a group, on average.
GROUP = 16


def limit(width: int) -> int:
    """The largest absolute integer for which width squared differences fit 63 bits."""
    return int(((2**63 - 1) // max(1, width)) ** 0.5) // 2 - 1


@dataclass
class Codebook:
    """One part's entries, the groups they belong to (fixed), and how far each moved last."""

    entries: np.ndarray  # (k, w) int64
    groups: list[np.ndarray]  # entries of each group, ascending
    drift: np.ndarray  # (k,) float64

    @classmethod
    def begun(cls, entries: np.ndarray, size: int = GROUP) -> Codebook:
        return cls(entries, grouped(entries, max(1, -(-len(entries) // size))), np.zeros(len(entries)))

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebook:
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = np.floor_divide(sums[used], counts[used, None])
        gap = (entries - self.entries).astype(np.float64)
        return Codebook(entries, self.groups, np.sqrt((gap * gap).sum(1)) * (1 + 1e-12))


def grouped(entries: np.ndarray, n: int) -> list[np.ndarray]:
    """Entries in at most n groups by a few k-means steps from evenly spread ones. Any grouping gives the same codes."""
    x = entries.astype(np.float64)
    if not len(x):
        return []
    centre = x[np.arange(n) * len(x) // n]
    for _ in range(5):
        near = ((x[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.stack([x[near == g].mean(0) if (near == g).any() else centre[g] for g in range(n)])
    return [np.flatnonzero(near == g) for g in range(n) if (near == g).any()]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances as exact int64: by a product of doubles where all sums stay below 2**53, else by differences."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if most * most * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def own_distance(x: np.ndarray, entries: np.ndarray, at: np.ndarray) -> np.ndarray:
    gap = x - entries[at]
    return (gap * gap).sum(1)


def _up(x):
    """At least the value, as float32."""
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _down(x):
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def first_codes(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, exact squared distance, upper bound, lower bounds) by a scan of all groups."""
    n, g = len(x), len(book.groups)
    at, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.full((n, g), -np.inf, np.float32)
    return assigned(x, book, at, upper, lower)


def assigned(x: np.ndarray, book: Codebook, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entries of rows whose bounds hold for the entries before their last move. scanned: gathers how many (row, group) pairs were scanned."""
    upper = _up(upper.astype(np.float64) + book.drift[at])
    lower = np.stack([_down(lower[:, g].astype(np.float64) - book.drift[m].max()) for g, m in enumerate(book.groups)], 1)
    exact = own_distance(x, book.entries, at)
    open_ = np.flatnonzero((lower <= upper[:, None]).any(1))  # the others keep their entry
    if len(open_):
        first, best, own = at[open_], exact[open_].copy(), at[open_].copy()
        tight = upper[open_] = _up(np.sqrt(best.astype(np.float64)) * (1 + 1e-12))
        need = lower[open_] <= tight[:, None]
        one, two = {}, {}
        for g, members in enumerate(book.groups):
            rows = np.flatnonzero(need[:, g])
            if not len(rows):
                continue
            if scanned is not None:
                scanned.append(len(rows))
            d = distances(x[open_[rows]], book.entries[members])
            j = d.argmin(1)  # the lowest of equals, as members ascend
            low = d[np.arange(len(rows)), j]
            d[np.arange(len(rows)), j] = np.iinfo(np.int64).max
            one[g], two[g] = (rows, members[j], low), d.min(1)
            better = (low < best[rows]) | ((low == best[rows]) & (members[j] < own[rows]))
            best[rows[better]], own[rows[better]] = low[better], members[j][better]
        group_of = np.empty(len(book.entries), np.int64)
        for g, members in enumerate(book.groups):
            group_of[members] = g
        new = lower[open_]
        left = np.flatnonzero(own != first)  # the entry left behind is one of its group's others now
        old = np.sqrt(exact[open_][left].astype(np.float64))
        new[left, group_of[first[left]]] = np.minimum(new[left, group_of[first[left]]], _down(old * (1 - 1e-12)))
        for g, (rows, which, low) in one.items():
            rest = np.where(which == own[rows], two[g], low)
            new[rows, g] = np.where(rest == np.iinfo(np.int64).max, np.float32(np.inf), _down(np.sqrt(rest.astype(np.float64)) * (1 - 1e-12)))
        lower[open_], at, upper[open_] = new, at.copy(), _up(np.sqrt(best.astype(np.float64)) * (1 + 1e-12))
        at[open_], exact[open_] = own, best
    return at, exact, upper, lower


def integers(column: pa.Array, width: int, parts: int = PARTS) -> np.ndarray:
    """floor(1024 * x) of an Arrow column of finite vectors of one width, filled with zeros to a multiple of parts."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if width else np.zeros((len(column), 0))
    most = limit(max(1, width))
    x = np.clip(np.floor(x * SCALE), -most, most).astype(np.int64)
    return np.pad(x, ((0, 0), (0, -width % parts)))


_ROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("embedding", pa.list_(pa.float32()))])
_STATE = "vec_id long, label string, embedding {kind}, codes binary, uppers binary, lowers binary"


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with finite vectors of the common width, as (vec_id, label, embedding), and that width (-1 without rows)."""
    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").where(finite)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).select(F.size("embedding")).first()
    return (rows.where(F.size("embedding") == first[0]), first[0]) if first else (rows, -1)


def begin(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> list[Codebook]:
    """The codebooks that the vectors of the smallest ids make."""
    table = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    x = integers(table.column(0).combine_chunks(), width, parts)
    return [Codebook.begun(np.ascontiguousarray(p)) for p in np.split(x, parts, axis=1)]


def _split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(x, parts, axis=1)]


def assign(rows: DataFrame, books: list[Codebook], width: int, first: bool) -> DataFrame:
    """rows with their codes and bounds for the books: a first full scan, or by the bounds that rows have."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    kind = rows.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, 16 << 20):
                n, out = part.num_rows, []
                cut = _split(integers(part.column(2), width, len(own)), len(own))
                if not first:
                    codes = _matrix(part.column(3), np.uint8, n)
                    uppers, lowers = _matrix(part.column(4), np.float32, n), _matrix(part.column(5), np.float32, n)
                at = 0
                for p, (x, book) in enumerate(zip(cut, own)):
                    g = len(book.groups)
                    out.append(first_codes(x, book) if first else assigned(x, book, codes[:, p].astype(np.int64), uppers[:, p].copy(), lowers[:, at : at + g].copy()))
                    at += g
                binary = lambda m: pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], binary(np.stack([o[0] for o in out], 1).astype(np.uint8)), binary(np.stack([o[2] for o in out], 1)), binary(np.concatenate([o[3] for o in out], 1))],
                    names=["vec_id", "label", "embedding", "codes", "uppers", "lowers"],
                )

    return rows.mapInArrow(run, _STATE.format(kind=kind))


def _matrix(column: pa.Array, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def summed(state: DataFrame, books: list[Codebook], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sums and counts of the parts by entry. Tasks add up their own rows; what they send meets in one shuffle of at most PARTS * ENTRIES rows a task."""
    sizes, parts = [len(b.entries) for b in books], len(books)
    w = books[0].entries.shape[1]
    names = ["slot", "n", *(f"s{i}" for i in range(w))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((k, w + 1), np.int64) for k in sizes]
        for batch in batches:
            x = _split(integers(batch.column(1), width, parts), parts)
            codes = _matrix(batch.column(0), np.uint8, batch.num_rows) if batch.num_rows else np.zeros((0, parts), np.uint8)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                if len(order):
                    sorted_codes = codes[order, p]
                    starts = np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]])
                    total[p][sorted_codes[starts], 1:] += np.add.reduceat(x[p][order], starts, axis=0)
                    total[p][:, 0] += np.bincount(codes[:, p], minlength=sizes[p])
        for p, t in enumerate(total):
            used = np.flatnonzero(t[:, 0])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used + p * ENTRIES), *(pa.array(t[used, c]) for c in range(w + 1))], names=names)

    found = state.select("codes", "embedding").mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("slot").agg(*(F.sum(c).alias(c) for c in names[1:]))
    out = [(np.zeros((k, w), np.int64), np.zeros(k, np.int64)) for k in sizes]
    for r in found.collect():
        p, e = divmod(r.slot, ENTRIES)
        out[p][1][e] = r.n
        out[p][0][e] = r[2:]
    return out


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook]]:
    """((vec_id, label, code, error) of the usable rows of rows(vec_id, embedding, label), the final codebooks)."""
    rows, width = usable(rows)
    if width < 0:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [Codebook.begun(np.zeros((0, 0), np.int64)) for _ in range(PARTS)]
    books, state = begin(rows, width), rows
    for i in range(rounds):
        before, state = state, materialize(assign(state, books, width, first=not i), f"codes-{i}")
        if i:
            discard(before)
        books = [b.moved(*s) for b, s in zip(books, summed(state, books, width))]
        if not any(b.drift.any() for b in books):
            break  # nothing moved: further rounds change nothing
    last = materialize(_errors(assign(state, books, width, first=not rounds), books, width), "codes-last")
    if rounds:
        discard(state)
    return last, books


def _errors(state: DataFrame, books: list[Codebook], width: int) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast([b.entries for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _matrix(batch.column(3), np.uint8, batch.num_rows)
            error = sum(own_distance(x, e, codes[:, p].astype(np.int64)) for p, (x, e) in enumerate(zip(_split(integers(batch.column(2), width, len(own)), len(own)), own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.hex() for c in batch.column(3).to_pylist()], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label string, code string, error long")


def decoded(codes: DataFrame, books: list[Codebook]) -> DataFrame:
    """codes(code, ...) with `vector`: the entries that a code names, as components (the entry's integers + 0.5, over SCALE)."""
    tables = F.array(*(F.array(*(F.array(*map(F.lit, ((e + 0.5) / SCALE).tolist())) for e in b.entries)) for b in books)) if len(books[0].entries) else None
    if tables is None:
        return codes.withColumn("vector", F.lit(None).cast("array<double>"))
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*(tables[p][entry(p)] for p in range(len(books))))))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes(label, error, ...) with label_error, the sum of errors over equal labels (nulls together). No label's rows meet in one task."""
    keyed = codes.withColumn("__key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = materialize(keyed.groupBy("__key").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")), "code-labels")
    total = sums.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return join_hot(keyed, sums, "__key", "__n", total).drop("__key", "__n")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = coded(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES: dict[str, str] = {}
