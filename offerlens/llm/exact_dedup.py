"""Operator 9, exact dedup: a static binary-fuse filter per immutable snapshot shard screens incoming digests.

A snapshot's distinct digests are cut into shards by their hash; each shard gets a binary-fuse filter (3 segments, 16-bit
fingerprints: about 18 bits a key, 1 in 65,536 false positives). take_snapshot() stores both; they are never changed, and later batches
are screened by them (open_snapshot(), known_texts()). Digests of the incoming batch are first grouped among themselves; each distinct
one is screened by its shard's filter, of which every part of a large batch gets a copy. A negative is surely new. A positive joins the exact bucket of its digest in
the snapshot. Groups of more than one row are then checked byte for byte against the row that stays; rows whose bytes
differ from it (a digest collision) are grouped again by their text.

exact_dedup() takes one table: rows of one half of the doc_ids' hashes are its snapshot, the others the batch.

Defined cases: a null text counts as empty; empty texts are equal to each other. The row with the largest doc_id of
equal texts stays; null doc_ids are smaller than any other. Rows that repeat one doc_id and text all say kept in the
flagged result; dedup_rows() keeps one of them. Very long texts count whole. An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, join_hot, materialize, mix64, read_table

#: Distinct digests in a shard of the snapshot, about: 8 MB of keys, 1.2 MB of filter.
SHARD_KEYS = 500_000
#: Digests of a batch that meet one copy of a filter, about: as many bytes as the filter.
SCREEN_KEYS = 16_384
#: Rows of one group that are checked against one copy of the text that stays.
CHECK_ROWS = 2048


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class BinaryFuse:
    """A static binary-fuse filter over distinct uint64 keys (3-wise, 16-bit fingerprints)."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix64(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
            g = mix64(h + np.uint64(0x632BE59BD9B4E019))
        mask = np.uint64(segment - 1)
        base = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
        slots = np.stack([base + (g & mask).astype(np.int64), base + segment + ((g >> np.uint64(20)) & mask).astype(np.int64), base + 2 * segment + ((g >> np.uint64(40)) & mask).astype(np.int64)])
        return slots, (h & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << min(18, max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        segments = max(1, -(-int(n * factor + 32) // segment) - 2)
        for seed in range(1, 200):
            slots, prints = cls._slots(keys, seed, segment, segments)
            order = cls._peel(slots, (segments + 2) * segment)
            if order is not None:
                break
            segments += max(1, segments // 50)
        else:
            raise RuntimeError("no seed peels the keys")
        table = np.zeros((segments + 2) * segment, np.uint16)
        for rows, at in reversed(order):  # keys of one round own different slots that no later round reads
            a, b, c = slots[:, rows]
            table[at] = 0
            table[at] = prints[rows] ^ table[a] ^ table[b] ^ table[c]
        return cls(seed, segment, segments, table)

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot that each alone holds), or None if some keys can't be peeled."""
        n = slots.shape[1]
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # the xor of a slot's keys: that of one key is the key
        for s in slots:
            np.bitwise_xor.at(held, s, np.arange(n))
        order, left, free = [], n, np.flatnonzero(count == 1)
        while len(free):
            rows, first = np.unique(held[free], return_index=True)
            at = free[first]
            order.append((rows, at))
            left -= len(rows)
            touched = slots[:, rows]
            for s in touched:
                np.subtract.at(count, s, 1)
                np.bitwise_xor.at(held, s, rows)
            near = np.unique(touched)
            free = near[count[near] == 1]
        return order if not left else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return (self.table[slots[0]] ^ self.table[slots[1]] ^ self.table[slots[2]]) == prints


def _key(digest: str = "digest") -> Column:
    return F.conv(F.hex(F.substring(F.col(digest), 1, 8)), 16, -10).cast("long")


@dataclass
class Snapshot:
    """groups(digest, n, keep_id) of distinct texts and filters(shard, seed, segment, segments, bits) of their digests."""

    groups: DataFrame
    filters: DataFrame
    shards: int


def digests(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    return docs.select("doc_id", digest(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))


def take_snapshot(rows: DataFrame, shard_keys: int = SHARD_KEYS, path: str | None = None) -> Snapshot:
    """Of rows(doc_id, digest); stored below path, if given, for open_snapshot()."""
    spark = rows.sparkSession
    groups = _grouped(rows)
    if path:
        groups.write.parquet(f"{path}/groups")
        groups = spark.read.parquet(f"{path}/groups")
    else:
        groups = materialize(groups, "snapshot")
    shards = max(1, -(-groups.count() // shard_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse.build(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "shards": [shards], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "bits": [f.table.tobytes()]})

    filters = groups.select(_shard(shards), _key().alias("key")).groupBy("shard").applyInPandas(build, "shard int, shards int, seed int, segment int, segments int, bits binary")
    if path:
        filters.write.parquet(f"{path}/filters")
        return open_snapshot(spark, path)
    return Snapshot(groups, materialize(filters, "filters"), shards)


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    filters = spark.read.parquet(f"{path}/filters")
    return Snapshot(spark.read.parquet(f"{path}/groups"), filters, filters.agg(F.max("shards")).first()[0] or 1)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def screen(incoming: DataFrame, snapshot: Snapshot, part_keys: int = SCREEN_KEYS) -> DataFrame:
    """incoming(digest, n, keep_id; one row a digest; materialised) with `maybe`: false only if the snapshot surely lacks the digest.

    The digests that meet one filter are dealt into parts of about part_keys, each with a copy of the filter, so a
    task's rows don't grow with the batch.
    """
    parts = max(1, -(-incoming.count() // (snapshot.shards * part_keys)))

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(right):
            r = right.iloc[0]
            f = BinaryFuse(int(r["seed"]), int(r["segment"]), int(r["segments"]), np.frombuffer(r["bits"], np.uint16))
            left["maybe"] = f.contains(left["key"].to_numpy(np.int64).view(np.uint64))
        else:
            left["maybe"] = False
        return left[["digest", "n", "keep_id", "maybe"]]

    part = F.pmod(F.xxhash64(F.lit("part"), "digest"), F.lit(parts)).cast("int").alias("part")
    keyed = incoming.select("digest", "n", "keep_id", _shard(snapshot.shards), part, _key().alias("key"))
    filters = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    fields = "digest binary, n long, keep_id long, maybe boolean"
    known = keyed.where("keep_id is not null").groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(test, fields)
    unnamed = keyed.where("keep_id is null").select("digest", "n", "keep_id", F.lit(True).alias("maybe"))  # pandas has no whole null numbers; these few join anyway
    return known.unionByName(unnamed)


def known_texts(docs: DataFrame, snapshot: Snapshot, snapshot_docs: DataFrame) -> DataFrame:
    """(doc_id, digest, known_id) of each row of a batch docs(doc_id, text): the row of the snapshot with the same bytes, null if it has none."""
    rows = materialize(digests(docs), "batch")
    positives = materialize(screen(materialize(_grouped(rows), "incoming"), snapshot).where("maybe").select("digest", "n"), "positives")
    met = materialize(join_checked(snapshot.groups.select("digest", "keep_id"), positives, ["digest"], "inner"), "met")
    plain = lambda d: d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stays = join_checked(plain(snapshot_docs).withColumn("digest", sha256(F.col("text"))), met.select("digest", F.col("keep_id").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    stays = stays.groupBy("digest").agg(F.min("text").alias("stays"))
    named = met.join(stays, "digest").select("digest", "n", "keep_id", "stays")
    batch = plain(docs).withColumn("digest", sha256(F.col("text")))
    found = join_hot(batch, materialize(named, "known"), "digest", "n", rows.count())
    return found.select("doc_id", "digest", F.when(F.col("text") == F.col("stays"), F.col("keep_id")).alias("known_id"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of each row of docs(doc_id, text); digest: of the text, as binary, 8 bytes or more."""
    rows = materialize(digests(docs, digest).withColumn("old", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), "digests")
    total = rows.count()
    snapshot = take_snapshot(rows.where("old"), shard_keys)
    screened = materialize(screen(materialize(_grouped(rows.where("not old")), "incoming"), snapshot), "screened")
    positives = materialize(screened.where("maybe").select("digest", F.col("n").alias("m"), F.col("keep_id").alias("new_id")), "positives")
    met = join_checked(snapshot.groups, positives, ["digest"], "left")
    met = met.select("digest", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("keep_id", "new_id").alias("keep_id"))
    true = materialize(join_checked(snapshot.groups.select("digest"), positives.select("digest"), ["digest"], "left_semi"), "true-positives")
    false = join_checked(positives, true, ["digest"], "left_anti")
    new = screened.where("not maybe").drop("maybe").unionByName(false.select("digest", F.col("m").alias("n"), F.col("new_id").alias("keep_id")))
    many = materialize(met.unionByName(new).where("n > 1"), "groups")
    wrong = _collisions(docs, rows, many, total, digest)
    out = join_hot(rows.select("doc_id", "digest"), many.withColumn("w", F.col("n")), "digest", "w", total).drop("w")
    out = out.select("doc_id", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"))
    if wrong is not None:
        out = out.join(wrong.select("digest").distinct(), "digest", "left_anti").unionByName(wrong)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _collisions(docs: DataFrame, rows: DataFrame, many: DataFrame, total: int, digest: Callable[[Column], Column]) -> DataFrame | None:
    """The rows of groups in which bytes differ, grouped by their text; None if there are none.

    Each member's bytes are compared with a copy of the text that stays. A group of n rows is dealt over n/CHECK_ROWS
    keys and the text that stays is copied for each, so no task gets a whole large group.
    """
    pick = many.select("digest", "keep_id", "n", (F.floor((F.col("n") - 1) / CHECK_ROWS) + 1).cast("int").alias("parts"))
    ids = join_hot(rows.select("doc_id", "digest"), pick, "digest", "n", total).where("parts is not null").select("doc_id", "digest", "keep_id", "n", "parts")
    ids = materialize(ids, "members")
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("parts")).cast("int").alias("salt")  # any salt will do
    wanted = ids.select("doc_id").where("doc_id is not null").distinct()
    plain = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = join_checked(plain.where("doc_id is not null"), wanted, ["doc_id"], "left_semi").unionByName(plain.where("doc_id is null"))
    texts = found.withColumn("digest", digest(F.col("text")))
    fields = ["doc_id", "text", "digest", "keep_id", "parts"]
    members = join_checked(texts.where("doc_id is not null"), ids.where("doc_id is not null").distinct(), ["doc_id", "digest"], "inner").select(*fields)
    unnamed = ids.where("doc_id is null").select("digest", "keep_id", "n", "parts").distinct()
    if not unnamed.isEmpty():  # one digest may have most of these rows
        plain_rows = materialize(texts.where("doc_id is null"), "unnamed")
        members = members.unionByName(join_hot(plain_rows, materialize(unnamed, "unnamed-groups"), "digest", "n", total).where("parts is not null").select(*fields))
    members = materialize(members, "texts")
    stays = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("stays"), F.max("parts").alias("parts"))
    stays = stays.select("digest", "stays", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    differ = members.select("digest", "text", salt).join(stays, ["digest", "salt"]).where("text != stays").select("digest").distinct()
    differ = materialize(differ, "collisions")
    if differ.isEmpty():
        return None
    again = members.join(differ, "digest", "left_semi")
    by_text = again.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return again.drop("keep_id", "parts").join(by_text, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")


def dedup_rows(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup() drops; of rows that repeat a doc_id and text, one stays. Only dropped rows are looked up."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    flags = exact_dedup(docs).groupBy(name.alias("__id"), F.col("digest").alias("__digest")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    flags = materialize(flags.where("not kept or n > 1"), "flags")
    on = ["__id", "__digest"]
    marked = docs.withColumns({"__id": name, "__digest": sha256(F.coalesce(F.col("text"), F.lit("")))})
    out = join_checked(marked, flags.select(*on), on, "left_anti")
    repeated = materialize(flags.where("kept").select(*on), "repeated")
    if not repeated.isEmpty():
        out = out.unionByName(join_checked(marked, repeated, on, "left_semi").dropDuplicates(on))
    return out.select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = exact_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return flags.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op9_exact_dedup": SQL}
