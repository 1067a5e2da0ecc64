"""Operator 5, mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, DataFrame operations only.

Targets are filled like water: target = min(3 * size, level * weight), where the level makes the targets sum to all
sizes. The total is cut into equal blocks; sources get whole blocks by the highest quotients target / (2k + 1). A
source is dealt by a hash into shards of about SHARD_DOCS documents and its blocks are apportioned to the shards by the
same rule, down a tree of at most FAN children a node, so every shard has an integer quota. A shard lays its documents out in a seeded order and takes its quota's
blocks from there: whole passes first, then a run of blocks. So no window ever holds more than one shard.

Defined cases: a null text has size 0 and is never taken; a very long one may be taken in part. Null sources are one source, last in order. Sources of size
0 get target 0. Rows that repeat a doc_id count as documents of their own; those
with other texts are dealt apart. Equal quotients go to the source that comes first, then to the smaller shard. An empty table gives an empty result. The
seed and hashes make reruns agree. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, join_checked, join_hot, materialize, read_table

#: No document is used more often than this.
MOST_PASSES = 3
#: Words in a block. Blocks are only counted, never made, so a small block costs nothing and keeps small sources near their targets.
BLOCK_WORDS = 4
#: Documents in a shard, about.
SHARD_DOCS = 8192
#: Children of a node in the tree by which a source's blocks are apportioned to its shards.
FAN = 1024
#: Sources ranked by one task, about.
RANK_ROWS = 100_000
SEED = 20_240_601


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """sources with `rank`, from 0, by key; rows are ranked within ranges, whose offsets are then added."""
    parts = max(1, -(-sources.count() // RANK_ROWS))
    spread = sources.repartitionByRange(parts, key).sortWithinPartitions(key)
    at = F.monotonically_increasing_id()
    spread = materialize(spread.withColumns({"part": F.shiftright(at, 33), "place": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    offsets = spread.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return spread.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("place")).drop("part", "place", "offset")


def water_level(sources: DataFrame, few: int = 10_000) -> float:
    """The level at which min(MOST_PASSES * source_size, level * weight) sums to all sizes.

    A source is full at the ratio MOST_PASSES * source_size / weight. Ratios are narrowed by their quantiles until few of them are left,
    which are gone through in order.
    """
    total = sources.agg(F.sum("source_size")).first()[0]
    if not total:
        return 0.0
    room = F.col("source_size") * MOST_PASSES
    ratios = sources.select((room / F.col("weight")).alias("ratio"), room.alias("room"), "weight").groupBy("ratio").agg(F.sum("room").alias("room"), F.sum("weight").alias("weight"))
    ratios = materialize(ratios, "ratios")
    below, above, left = 0, 0, ratios  # room of the full ones, weight of those that can't be full, what is undecided
    while left.count() > few:
        cuts = sorted(set(left.approxQuantile("ratio", [k / 64 for k in range(1, 64)], 0.002)))
        part = sum((F.when(F.col("ratio") > c, 1).otherwise(0) for c in cuts), F.lit(0))
        sums = {r.part: (r.room, r.weight) for r in left.groupBy(part.alias("part")).agg(F.sum("room").alias("room"), F.sum("weight").alias("weight")).collect()}
        k, rest = 0, above + sum(w for _, w in sums.values())
        while k < len(cuts) and below + sums.get(k, (0, 0))[0] + cuts[k] * (rest - sums.get(k, (0, 0))[1]) < total:  # all of part k are full
            below, rest = below + sums.get(k, (0, 0))[0], rest - sums.get(k, (0, 0))[1]
            k += 1
        above = rest - sums.get(k, (0, 0))[1]
        left = left.where((F.col("ratio") > cuts[k - 1] if k else F.lit(True)) & (F.col("ratio") <= cuts[k] if k < len(cuts) else F.lit(True)))
    rows = sorted(left.collect())
    rest, level = above + sum(r.weight for r in rows), 0.0
    for r in rows:
        if below + r.ratio * rest >= total:
            break
        below, rest, level = below + r.room, rest - r.weight, r.ratio
    return (total - below) / rest if rest else level


def _near(share: Column, missing: Column) -> Column:
    """How many quotients of one party may be among the `missing` that decide: its share of them twice over, and two."""
    return (F.ceil(share * F.abs(missing) * 2) + 2).cast("long")


def _candidates(df: DataFrame, value: str, missing: str) -> DataFrame:
    """df(seats, room, near, ...) with a row for each quotient near the decision: k, quotient and `order` (first taken or given up first)."""
    lo = F.when(F.col(missing) > 0, F.col("seats")).otherwise(F.greatest(F.lit(0), F.col("seats") - F.col("near")))
    hi = F.when(F.col(missing) > 0, F.least(F.col("room"), F.col("seats") + F.col("near"))).otherwise(F.col("seats")) - 1
    rows = df.withColumns({"lo": lo.cast("long"), "hi": hi.cast("long")}).where(f"hi >= lo and {missing} != 0")
    rows = rows.withColumn("k", F.explode(F.sequence("lo", "hi"))).withColumn("quotient", F.col(value) / (2 * F.col("k") + 1))
    return rows.withColumn("order", F.when(F.col(missing) > 0, -F.col("quotient")).otherwise(F.col("quotient")))


def apportion_sources(sources: DataFrame, block: int) -> DataFrame:
    """sources(skey, source_size, target) with `blocks`: whole blocks by the highest quotients target / (2k + 1), at most as many as three passes hold."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    blocks = max(1, round(total / block)) if total else 0
    share = F.col("target") / F.lit(float(max(total, 1)))
    room = F.ceil(F.col("source_size") * MOST_PASSES / block).cast("long")
    first = sources.withColumns({"room": room, "seats": F.least(F.floor(share * blocks + 0.5), room).cast("long")})
    missing = blocks - (first.agg(F.sum("seats")).first()[0] or 0)
    first = first.withColumns({"missing": F.lit(missing), "near": _near(share, F.lit(missing))})
    if missing:
        decided = _candidates(first, "target", "missing").orderBy("order", "skey", "k").limit(abs(missing)).groupBy("skey").agg(F.count("*").alias("turned"))
        first = first.join(decided, "skey", "left")
    else:
        first = first.withColumn("turned", F.lit(0))
    return first.withColumn("blocks", F.col("seats") + F.signum(F.lit(missing)).cast("long") * F.coalesce("turned", F.lit(0))).drop("room", "seats", "missing", "near", "turned")


def apportion_shards(shards: DataFrame, block: int) -> DataFrame:
    """shards(skey, above, shard, shard_size, above_size, blocks) with `quota`, whole blocks that sum to those of the node above."""
    own = Window.partitionBy("skey", "above")
    share = F.col("shard_size") / F.greatest(F.col("above_size"), F.lit(1))
    room = F.ceil(F.col("shard_size") * MOST_PASSES / block).cast("long")
    first = shards.withColumns({"room": room, "seats": F.least(F.floor(share * F.col("blocks") + 0.5), room).cast("long")})
    first = first.withColumn("missing", F.col("blocks") - F.sum("seats").over(own)).withColumn("near", _near(share, F.col("missing")))
    first = materialize(first, "shards")
    place = F.row_number().over(own.orderBy("order", "shard", "k"))
    decided = _candidates(first, "shard_size", "missing").withColumn("place", place).where("place <= abs(missing)").groupBy("skey", "shard").agg(F.count("*").alias("turned"))
    return first.join(decided, ["skey", "shard"], "left").select("skey", "shard", "shard_size", (F.col("seats") + F.signum("missing").cast("long") * F.coalesce("turned", F.lit(0))).alias("quota"))


def shard_quotas(sized: DataFrame, block: int, fan: int) -> DataFrame:
    """sized(skey, shard, shard_size, source_size, blocks) with `quota`. Shards are leaves of a tree in which no node has more than `fan` children, apportioned from the top, so no task gets a whole large source."""
    depth, most = 1, (sized.agg(F.max("shard")).first()[0] or 0) + 1
    while most > fan**depth:
        depth += 1
    quotas = None
    for level in range(depth - 1, -1, -1):
        node, above = F.floor(F.col("shard") / fan**level), F.floor(F.col("shard") / fan ** (level + 1))
        nodes = sized.groupBy("skey", above.alias("above"), node.alias("shard")).agg(F.sum("shard_size").alias("shard_size"), F.first("source_size").alias("above_size"), F.first("blocks").alias("blocks"))
        if quotas is not None:
            nodes = nodes.drop("above_size", "blocks").join(quotas.select("skey", F.col("shard").alias("above"), F.col("shard_size").alias("above_size"), F.col("quota").alias("blocks")), ["skey", "above"])
        quotas = materialize(apportion_shards(nodes, block), "shard-quotas")
    return quotas


def mix(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, skey, size, source_size, target, taken) of each row of docs(doc_id, source, text)."""
    skey = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    rows = docs.select("doc_id", skey.alias("skey"), size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("print"))
    rows = materialize(rows.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size")), "sizes")
    sources = ranked(rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "skey")
    sources = materialize(sources.withColumn("weight", F.col("rank") % 3 + 1), "sources")
    level = water_level(sources)
    sources = sources.withColumn("target", F.least(F.col("source_size") * float(MOST_PASSES), F.col("weight") * F.lit(level)))
    sources = sources.withColumn("parts", (F.floor((F.col("n_docs") - 1) / SHARD_DOCS) + 1).cast("long"))
    sources = materialize(apportion_sources(sources, block).drop("rank", "weight"), "quotas")
    dealt = join_hot(rows, sources, "skey", "n_docs", rows.count())
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "doc_id", "print"), F.col("parts")))
    sized = dealt.groupBy("skey", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("blocks").alias("blocks"))
    quotas = shard_quotas(materialize(sized, "shard-sizes"), block, FAN)
    laid = Window.partitionBy("skey", "shard").orderBy("place", "doc_id", "size")
    laid = dealt.join(quotas, ["skey", "shard"]).withColumn("end", F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.least(F.col("quota") * block, F.col("shard_size") * MOST_PASSES)
    passes, rest = F.floor(words / F.greatest("shard_size", F.lit(1))), F.col("words") - F.col("passes") * F.col("shard_size")
    laid = laid.withColumn("words", words).withColumn("passes", passes).withColumn("rest", rest)
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least("end", "rest") - (F.col("end") - F.col("size")))
    return laid.select("doc_id", "skey", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as rows of docs: each document as often as the mix takes it, to the nearest whole (a block's run ends inside one document a shard)."""
    skey = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    taken = mix(docs, block, seed).groupBy("doc_id", "skey", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"))
    copies = F.floor(F.col("taken") / (F.col("n") * F.greatest("size", F.lit(1))) + 0.5).cast("int")
    taken = materialize(taken.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("skey").alias("__skey"), F.col("size").alias("__size"), copies.alias("__copies")).where("__copies > 0"), "copies")
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__skey": skey, "__size": size_of(F.col("text"))})
    out = join_checked(keyed, taken, ["__id", "__skey", "__size"], "inner")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_source_mix": op5_source_mix}
ORACLES: dict[str, str] = {}
