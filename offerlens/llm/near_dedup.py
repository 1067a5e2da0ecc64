"""Operator 4, MinHash near-dedup by tensored banding.

A document's set holds the hashes of its distinct word shingles. Two collections of GROUPS groups of HALF minhashes
each are computed once; every pair of a group from the first and one from the second forms a table key, so
GROUPS * GROUPS tables of 2 * HALF minhashes need only 2 * GROUPS * HALF minhashes instead of GROUPS**2 * 2 * HALF. A link
of exactly 0.8 meets in no table with a probability of 2 * (1 - 0.8**2)**8, 0.0006; closer ones far less often.

Equal sets become one class first, told apart by a 64-bit hash of the set. Classes that share a bucket are candidates.
They are never paired with each other: each meets its buckets' pivots, the classes that share most buckets with others.

1. Each class is compared on full sets with the pivot that it shares most buckets with; then with those of its other
   pivots that are not in its component yet. All these candidates are decided now.
2. Two classes may be linked though they met only a pivot in common. A group is a component that holds a pivot and all
   classes that met it. Only groups with classes of several components are looked at further. Each class of a group is compared with the
   group's centre, which gives the shingles it adds to the centre and those it lacks. What more than half of the group
   adds or lacks is corrected in the centre: a consensus set C, with each class as C without r removed and with a added
   shingles. With t the least similarity, c = t / (1 + t) and w = (1 - c) r + c a, the classes x and y are linked if and only if they have
   at least w_x + w_y - (1 - 2c)|C| of these differences in common. The class with the least w is compared with all of
   its group by this. For all others the bound is above 0, so those that are linked share a difference, and by the prefix rule of
   set joins one among the first of each (rare ones first, added before removed). Classes of different components that share such a difference
   and can reach the bound by their numbers of differences are compared exactly; if they share no added one, the removed ones must reach it.

So no link between classes that share a bucket is lost, and copies that are in one component, or too far apart, make no pairs.

Defined cases: null and empty texts have an empty set and are linked with nothing; texts with fewer words than a shingle
have the sequence as one. Very long texts are compared whole, in numpy. Null doc_ids are linked with nothing (component_id null, kept).
Rows that repeat a doc_id count by their own texts; equal sets are linked. An empty table gives an empty result.
Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, join_checked, join_hot, materialize, mix64, read_table, slices, text_buffer, tokens
from .graph import components

GROUPS, HALF = 8, 2
HASHES = 2 * GROUPS * HALF
#: Pairs with one pivot that one task's group confirms.
PIVOT_PAIRS = 256
#: Classes in one file, rows of few numbers in one file, and pairs or rows with lists of differences that one task gets, where many are needed.
CLASS_ROWS, NARROW_ROWS, LIST_ROWS = 8_000, 200_000, 500
#: Numbers that a broadcast lookup of groups may hold.
GROUP_NUMBERS = 2_000_000
_ODD = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_ADD = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, in a row, and where each text's begin."""
    _, _, doc, h = tokens(data, bounds)
    n = len(bounds) - 1
    many = np.bincount(doc, minlength=n)
    begin = np.concatenate([[0], np.cumsum(many)])
    with np.errstate(over="ignore"):
        s = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for k in range(words):
            s = mix64(s * np.uint64(0x9FB21C651E98DF25) + h[k : k + len(s)] + np.uint64(1))
        at = doc[: len(s)]
        whole = at == doc[words - 1 : words - 1 + len(s)]
        s, at = s[whole], at[whole]
        few = np.flatnonzero((many > 0) & (many < words))
        if len(few):
            own = []
            for d in few:
                x = np.uint64(many[d])
                for y in h[begin[d] : begin[d + 1]]:
                    x = mix64(np.array([x * np.uint64(0x9FB21C651E98DF25) + y + np.uint64(7)]))[0]
                own.append(x)
            s, at = np.concatenate([s, np.array(own, np.uint64)]), np.concatenate([at, few])
    order = np.lexsort((s, at))
    s, at = s[order], at[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1])
    return s[new], np.concatenate([[0], np.cumsum(np.bincount(at[new], minlength=n))])


def minhashes(s: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """[texts, HASHES] of uint32; texts with empty sets have the largest value."""
    n = len(begin) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(begin) > 0)
    if len(full):
        with np.errstate(over="ignore"):
            for j in range(HASHES):
                out[full, j] = np.minimum.reduceat(((s * _ODD[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32), begin[full])
    return out


def table_keys(signature: np.ndarray) -> np.ndarray:
    """[texts, GROUPS * GROUPS] of int64: a key for each pair of a group of the first collection and one of the second."""
    with np.errstate(over="ignore"):
        g = signature.reshape(len(signature), 2 * GROUPS, HALF).astype(np.uint64)
        x = np.zeros(g.shape[:2], np.uint64)
        for k in range(HALF):
            x = mix64(x * np.uint64(0x9FB21C651E98DF25) + g[:, :, k] + np.uint64(1))
        table = np.arange(GROUPS * GROUPS, dtype=np.uint64).reshape(GROUPS, GROUPS) * np.uint64(0xD6E8FEB86659FD93)
        keys = mix64(x[:, :GROUPS, None] * np.uint64(0xE7037ED1A0B428DB) + x[:, None, GROUPS:] + table[None])
    return keys.reshape(len(signature), -1).view(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, rid: a hash of the text, n_shingles, node: a hash of the set, signature) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s, begin = shingle_sets(*text_buffer(part.column(2)), words)
                n = np.diff(begin)
                sums = np.zeros(len(n), np.uint64)
                full = np.flatnonzero(n > 0)
                if len(full):
                    with np.errstate(over="ignore"):
                        sums[full] = mix64(np.add.reduceat(mix64(s + np.uint64(0x9E3779B97F4A7C15)), begin[full]) + n[full].astype(np.uint64))
                signature = minhashes(s, begin)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sums.view(np.int64)), pa.array([x.tobytes() for x in signature], pa.binary())], schema=schema)

    return with_rid(docs).mapInArrow(run, "doc_id long, rid long, n_shingles long, node long, signature binary")


def with_rid(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("rid"), "text")


def table_rows(classes: DataFrame) -> DataFrame:
    """classes(node, signature) as (key, node), a row for each table."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                signature = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, HASHES)
                node = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(table_keys(signature).ravel()), pa.array(np.repeat(node, GROUPS * GROUPS))], schema=schema)

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def met_pivots(classes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(node, pivot, shared: buckets), and (node, weight) of the n classes in buckets with others. A bucket's pivot is its class with most weight: classes met in all its buckets."""
    busy = table_rows(classes).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(table_rows(classes).join(busy.hint("merge"), "key"), "buckets", n * GROUPS * GROUPS, NARROW_ROWS)
    weights = materialize(members.groupBy("node").agg(F.sum("n").alias("weight")), "weights", n)
    tops = members.join(weights.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    met = members.join(tops.hint("merge"), "key").where("node != pivot").groupBy("node", "pivot").agg(F.count("*").alias("shared"))
    met = materialize(met, "met", n * GROUPS * GROUPS, NARROW_ROWS)
    discard(members)
    return met, weights


def compared(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int, differences: bool = False) -> DataFrame:
    """pairs(node, pivot) with linked, by the full sets, and, if wanted, the pivot's size and the shingles added to the pivot's and removed from them.

    A pivot's text meets at most PIVOT_PAIRS or so others in a group; a task holds one pivot's set at a time.
    """
    total = pairs.count()
    many = pairs.groupBy("pivot").agg((F.floor((F.count("*") - 1) / PIVOT_PAIRS) + 1).alias("parts")).where("parts > 1")
    dealt = join_checked(pairs.select("node", "pivot"), materialize(many, "large-pivots", total // PIVOT_PAIRS), ["pivot"])
    dealt = materialize(dealt.select("node", "pivot", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")), "dealt")
    wanted = dealt.select("node").unionByName(dealt.select(F.col("pivot").alias("node"))).distinct()
    rows = materialize(classes.join(wanted, "node").select("node", F.col("rep").alias("doc_id"), "rid"), "wanted", 2 * total)
    count = rows.count()
    found_texts = materialize(join_checked(with_rid(docs), rows, ["doc_id", "rid"], "inner", count).select("node", "text"), "texts")
    texts = found_texts if found_texts.count() == count else found_texts.dropDuplicates(["node"])  # rows that repeat
    pivots = dealt.select("pivot", "part").distinct().select("pivot", "part", F.lit(None).cast("long").alias("node"), F.col("pivot").alias("who"))
    both = pivots.unionByName(dealt.select("pivot", "part", "node", F.col("node").alias("who")))
    both = both.join(texts.withColumnRenamed("node", "who"), "who").select("pivot", "part", "node", "text")
    both = both.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("node").asc_nulls_first())
    both = both.coalesce(max(1, -(-total // LIST_ROWS)))  # groups stay whole and in order
    fields = [("node", pa.int64()), ("pivot", pa.int64()), ("linked", pa.bool_())] + [("size", pa.int64()), ("added", pa.list_(pa.int64())), ("removed", pa.list_(pa.int64()))] * differences
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch):
                s, begin = shingle_sets(*text_buffer(part.column(3)), words)
                out = []
                for i, (pivot, node) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    own = s[begin[i] : begin[i + 1]]
                    if node is None:
                        other = own.copy()
                        continue
                    met = len(np.intersect1d(own, other, assume_unique=True))
                    linked = met > 0 and 100 * met >= percent * (len(own) + len(other) - met)
                    out.append((node, pivot, linked))
                    if differences:
                        out[-1] += (len(other), np.setdiff1d(own, other, assume_unique=True).view(np.int64), np.setdiff1d(other, own, assume_unique=True).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(schema), schema.types)], schema=schema)

    found = materialize(both.mapInArrow(run, "node long, pivot long, linked boolean" + ", size long, added array<long>, removed array<long>" * differences), "compared")
    discard(dealt, found_texts, rows)
    return found


def links(found: DataFrame) -> DataFrame:
    return found.where("linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def apart(pairs: DataFrame, parts: DataFrame, a: str, b: str) -> DataFrame:
    """pairs whose ends are in different components, with these as ca and cb."""
    rows = parts.count()
    of = lambda t, who, name: join_checked(t, parts.select(F.col("node").alias(who), F.col("component").alias(name)), [who], "left", rows)
    placed = of(of(pairs, a, "ca"), b, "cb")
    return placed.withColumns({"ca": F.coalesce("ca", a), "cb": F.coalesce("cb", b)}).where("ca != cb")


def groups(pairs: DataFrame, parts: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, pivot: the centre) of the groups to be searched; pairs(node, pivot): those that are not linked."""
    outside = materialize(apart(pairs, parts, "node", "pivot").select("node", "ca", F.col("cb").alias("g")).distinct(), "outside", pairs.count(), NARROW_ROWS)
    total, classes = outside.count(), weights.count()
    heads = materialize(outside.groupBy("g").agg(F.min("ca").alias("lo"), F.max("ca").alias("hi")), "heads", total)
    named = join_checked(join_checked(weights, parts, ["node"]).select("node", "weight", F.coalesce("component", "node").alias("g")), heads, ["g"], "inner")
    sized = named.groupBy("g").agg(F.count("*").alias("members"), F.max(F.struct("weight", "node")).alias("top"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    sized = materialize(sized.where("members > 1 or lo != hi").select("g", F.col("top.node").alias("pivot")), "centres", min(total, classes))  # else all pairs of the group were compared
    rows = sized.count()
    of = lambda t: join_checked(t, sized, ["g"], "inner", rows).select("node", "pivot")
    return materialize(of(named.select("g", "node")).unionByName(of(outside.select("g", "node"))).where("node != pivot").distinct(), "groups", total + classes)


def _size_sum(x: str, y: str) -> Column:
    return F.size(F.array_intersect(x, y)).cast("long")


def _by_group(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows with one row of values for each group; broadcast if these are few and small."""
    sizes = sum((F.size(c).cast("long") for c, t in values.dtypes if t.startswith("array")), F.lit(8))
    n, numbers = values.agg(F.count("*"), F.sum(sizes)).first()
    return join_checked(rows, values, ["g"], "inner", 0 if n <= BROADCAST_ROWS and (numbers or 0) <= GROUP_NUMBERS else 1, 0)


def around_consensus(found: DataFrame, percent: int) -> DataFrame:
    """found(node, pivot, size, added, removed), of whole groups, as (g, node, a, r, na, nr, size: of the consensus, w, free): by differences from their consensus."""
    centre = found.groupBy("pivot").agg(F.first("size").alias("size"))
    none = F.array().cast("array<long>")
    rows = found.select(F.col("pivot").alias("g"), "node", "size", "added", "removed").unionByName(centre.select(F.col("pivot").alias("g"), F.col("pivot").alias("node"), "size", none.alias("added"), none.alias("removed")))
    total = found.count()
    sizes = materialize(rows.groupBy("g").agg(F.count("*").alias("n")), "group-sizes", total)
    each = rows.select("g", F.explode(F.concat(F.transform("added", lambda x: F.struct(x.alias("x"), F.lit(True).alias("new"))), F.transform("removed", lambda x: F.struct(x.alias("x"), F.lit(False).alias("new"))))).alias("d"))
    often = each.groupBy("g", "d.x", "d.new").agg(F.count("*").alias("k")).where("k > 1")
    often = _by_group(often, sizes).where("2 * k > n")
    flips = often.groupBy("g").agg(F.collect_list(F.when(F.col("new"), F.col("x"))).alias("fa"), F.collect_list(F.when(~F.col("new"), F.col("x"))).alias("fr"))  # at most twice a set's size
    flips = materialize(sizes.select("g").join(flips, "g", "left").select("g", F.coalesce("fa", none).alias("fa"), F.coalesce("fr", none).alias("fr")), "flips", total, LIST_ROWS)
    with_flips = _by_group(rows, flips)
    a = F.concat(F.array_except("added", "fa"), F.array_except("fr", "removed"))
    r = F.concat(F.array_except("removed", "fr"), F.array_except("fa", "added"))
    c = percent / (100 + percent)
    out = with_flips.select("g", "node", a.alias("a"), r.alias("r"), (F.col("size") + F.size("fa") - F.size("fr")).alias("size"))
    out = out.withColumns({"na": F.size("a"), "nr": F.size("r")}).withColumns({"w": (1 - c) * F.col("nr") + c * F.col("na"), "free": (1 - 2 * c) * F.col("size")})
    return materialize(out, "around")


def _linked(x: str, y: str, percent: int) -> Column:
    """Whether the classes of two rows (struct columns) of one group are linked, by whole numbers."""
    both = F.col(f"{x}.size") - F.col(f"{x}.nr") - F.col(f"{y}.nr") + _size_sum(f"{x}.r", f"{y}.r") + _size_sum(f"{x}.a", f"{y}.a")
    sizes = sum((F.col(f"{t}.size") - F.col(f"{t}.nr") + F.col(f"{t}.na") for t in (x, y)), F.lit(0))
    return (both > 0) & (100 * both >= percent * (sizes - both))


def middle_links(around: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of each class with the one nearest to its group's consensus."""
    nearest = around.groupBy("g").agg(F.min(F.struct("w", "node")).alias("y")).select("g", F.col("y.node").alias("node"))
    nearest = materialize(around.join(nearest, ["g", "node"]).select("g", F.col("node").alias("other"), F.col("a").alias("ya"), F.col("r").alias("yr")), "middles")
    own = _by_group(around, nearest).where("node != other")
    x = F.struct(*(F.col(c) for c in ("a", "r", "na", "nr", "size"))).alias("x")
    y = F.struct(F.col("ya").alias("a"), F.col("yr").alias("r"), F.size("ya").alias("na"), F.size("yr").alias("nr"), "size").alias("y")
    return materialize(own.select("node", "other", x, y).where(_linked("x", "y", percent)).select(F.col("node").alias("a"), F.col("other").alias("b")), "middle-links")


def far_links(around: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within a group between classes of different components, of which at least one isn't in the component of the class nearest to the consensus."""
    rows = join_checked(around, parts, ["node"]).withColumn("part", F.coalesce("component", "node")).drop("component")
    heads = rows.groupBy("g").agg(F.min(F.struct("w", "node", "part")).alias("y"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi")
    heads = materialize(heads.select("g", F.col("y.part").alias("main"), F.col("y.w").alias("w_near")), "heads", around.count())
    rows = materialize(_by_group(rows, heads).withColumn("out", F.col("part") != F.col("main")), "rows")
    least = rows.groupBy("g").agg(F.min(F.when(F.col("out"), F.col("w"))).alias("w_out"))
    rows = materialize(_by_group(rows.drop("main"), least), "rows-bounds")
    tokens = rows.select("g", "node", "part", "out", F.explode(F.concat(F.transform("a", lambda x: F.struct(x.alias("x"), F.lit(0).alias("kind"))), F.transform("r", lambda x: F.struct(x.alias("x"), F.lit(1).alias("kind"))))).alias("d"))
    tokens = tokens.select("g", "node", "part", "out", "d.x", "d.kind")
    shared = tokens.groupBy("g", "x").agg(F.count("*").alias("n"), F.max("out").alias("o"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("n > 1 and o and lo != hi").select("g", "x", "n")
    total = rows.agg(F.coalesce(F.sum("na") + F.sum("nr"), F.lit(0))).first()[0]
    shared = materialize(shared, "shared", total // 2, NARROW_ROWS)
    met = tokens.join(shared.hint("merge"), ["g", "x"]).select("g", "node", "x", "kind", "n")
    kept = F.count("*").over(Window.partitionBy("g", "node", "kind"))
    place = F.row_number().over(Window.partitionBy("g", "node", "kind").orderBy("n", "x"))
    met = met.withColumns({"kept": kept, "place": place})
    slim = rows.select("g", "node", "part", "out", "na", "nr", "w", "free", "w_out", "w_near")
    met = met.join(slim, ["g", "node"])
    # of a kind, those that nobody shares come first
    at = F.col("place") + F.when(F.col("kind") == 0, F.col("na") - F.col("kept")).otherwise(F.col("na") + F.col("nr") - F.col("kept"))
    prefix = lambda other: F.col("na") + F.col("nr") - F.greatest(F.lit(1), F.ceil(F.col("w") + F.col(other) - F.col("free") - 1e-6)) + 1
    met = met.withColumns({"with_out": at <= prefix("w_out"), "with_near": F.col("out") & (at <= prefix("w_near"))}).where("with_out or with_near")
    met = materialize(met.drop("place", "kept", "n", "w_out", "w_near"), "prefixes", total, NARROW_ROWS)
    p, q = met.where("out").alias("p"), met.alias("q")
    need = F.col("p.w") + F.col("q.w") - F.col("p.free") - 1e-6
    fits = F.least("p.nr", "q.nr") + F.when(F.col("p.kind") == 0, F.least("p.na", "q.na")).otherwise(0) >= need
    on = (F.col("p.g") == F.col("q.g")) & (F.col("p.x") == F.col("q.x")) & (F.col("p.part") != F.col("q.part")) & fits
    order = F.when(F.col("q.out"), F.col("p.with_out") & F.col("q.with_out") & (F.col("p.node") > F.col("q.node"))).otherwise(F.col("p.with_near") & F.col("q.with_out"))
    pairs = p.join(q, on & order).select(F.col("p.g").alias("g"), F.col("p.node").alias("node"), F.col("q.node").alias("other")).distinct()
    pairs = materialize(pairs, "far-pairs")
    sets = lambda who, name: around.select("g", F.col("node").alias(who), F.struct("a", "r", "na", "nr", "size").alias(name))
    tested = pairs.join(sets("node", "x"), ["g", "node"]).join(sets("other", "y"), ["g", "other"])
    return materialize(tested.where(_linked("x", "y", percent)).select(F.col("node").alias("a"), F.col("other").alias("b")), "far-links")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs(doc_id, text): links where 100 * intersection >= percent * union."""
    return flagged(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def flagged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_dedup() with the text's hash (rid) and the component (part) of each row."""
    docs = docs.select("doc_id", "text")
    rows = materialize(sketches(docs, words), "sketches")
    total = rows.count()
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("node").agg(F.min(F.struct("doc_id", "rid", "signature")).alias("m"), F.count("*").alias("n"))
    classes = materialize(classes.select("node", F.col("m.doc_id").alias("rep"), F.col("m.rid").alias("rid"), F.col("m.signature").alias("signature"), "n"), "classes", total, CLASS_ROWS)
    met, weights = met_pivots(classes, classes.count())
    best = met.groupBy("node").agg(F.max(F.struct("shared", "pivot")).alias("b")).select("node", F.col("b.pivot").alias("pivot"))
    first = compared(docs, classes, materialize(best, "best", weights.count()), words, percent)
    found = links(first)
    parts = components(found)
    again = apart(met.join(first, ["node", "pivot"], "left_anti"), parts, "node", "pivot").select("node", "pivot")
    second = compared(docs, classes, materialize(again, "again"), words, percent)
    found = found.unionByName(links(second))
    parts = components(found)
    group = groups(met, parts, weights)
    if not group.isEmpty():
        third = compared(docs, classes, group, words, percent, differences=True)
        around = around_consensus(third, percent)
        found = found.unionByName(links(third)).unionByName(middle_links(around, percent))
        parts = components(found)
        far = far_links(around, parts, percent)
        if not far.isEmpty():
            parts = components(found.unionByName(far))
    named = join_checked(classes, parts, ["node"]).select("node", "n", "rep", F.coalesce("component", "node").alias("part"))
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"), F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 1 or n > 1").drop("k", "n")
    named = join_checked(named, materialize(least, "components", total), ["part"], "inner").select("node", "n", "component_id", "part")
    named = materialize(named, "named")
    out = join_hot(rows.select("doc_id", "rid", "n_shingles", "node"), named, "node", "n", total)
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", linked.alias("component_id"), F.col("doc_id").eqNullSafe(linked).alias("kept"), "rid", F.coalesce("part", "node").alias("part"))


def near_dedup_rows(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, that with the smallest doc_id.

    Of rows that repeat its doc_id within the group, the one with the smallest hash of its text stays. Rows that are linked with nothing stay all.
    """
    flags = flagged(docs, words, percent).where("doc_id is not null and n_shingles > 0")
    texts = materialize(flags.groupBy("doc_id", F.col("rid").alias("__rid")).agg(F.max("kept").alias("kept"), F.min("part").alias("part"), F.count("*").alias("n")), "texts")
    stays = texts.where("kept").groupBy("doc_id", "part").agg(F.min("__rid").alias("__rid")).select("doc_id", "__rid")
    goes = materialize(texts.join(stays, ["doc_id", "__rid"], "left_anti").select("doc_id", "__rid"), "goes")
    out = join_checked(docs.withColumn("__rid", F.xxhash64("text")), goes, ["doc_id", "__rid"], "left_anti")
    repeated = materialize(texts.where("n > 1").join(stays, ["doc_id", "__rid"], "left_semi").select("doc_id", "__rid"), "repeated")
    if not repeated.isEmpty():
        once = join_checked(out, repeated, ["doc_id", "__rid"], "left_semi").dropDuplicates(["doc_id", "__rid"])
        out = join_checked(out, repeated, ["doc_id", "__rid"], "left_anti").unionByName(once)
    return out.select(*docs.columns)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)


#: Links by the prefix rule of set joins: linked sets share one of each one's rarest shingles.
SQL = r"""
WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
often AS (SELECT x, count(*) AS f FROM rows GROUP BY x),
ordered AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS place FROM rows JOIN often USING (x)),
prefix AS (SELECT doc_id, n, x FROM ordered WHERE place <= n - ceil(0.8 * n) + 1),
candidates AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM prefix p JOIN prefix q USING (x) WHERE p.doc_id < q.doc_id AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)),
linked AS (SELECT a, b FROM candidates JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
           WHERE 100 * len(list_intersect(p.s, q.s)) >= 80 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, w.b FROM reached r JOIN ways w ON w.a = r.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM sets JOIN (SELECT a, min(b) AS m FROM reached GROUP BY a) ON a = doc_id
"""
QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
ORACLES = {"op4_minhash_near_dedup": SQL}
