"""Operator 6, substring dedup by prefix-partitioned suffix trees over words.

Only repeats of WINDOW words matter, so trees end at that depth. Equal texts are found first: a copy with a larger doc_id
has all its windows in a smaller one, and stays out of the trees.

Suffixes are taken at anchors: the first of the smallest hashes among a window's GRAM-word sequences. Equal windows have equal anchors at
equal places, so these suffixes meet all repeats. Their prefix of GRAM words deals them into groups. A prefix in one
document only can't repeat; one with more than GROUP_ROWS suffixes is lengthened, on both sides, to the whole window, so
that each group fits in memory (or is one node of depth WINDOW, of which only the smallest doc_id has to be known).
Prefixes that are frequent in a sample (which only decides how they are dealt, not what is found) are known to be shared and aren't
shuffled; nodes below them with HOT_SHARE of their windows or more, of which there can't be more than 1 / HOT_SHARE, are broadcast.

A task orders a group's suffixes by their words. Lengths of common prefixes give the subtree's nodes; a node at depth
WINDOW - k, split by the k words before the anchor, is a repeated window that begins k words before the anchor. Its smallest
doc_id tells which suffixes repeat. Repeated windows that overlap or touch join to the maximal repeats that are removed.

Defined cases: null texts have no words. Rows with a null doc_id neither lose words nor make others lose any. Rows that
repeat a doc_id don't count as smaller to each other and each is judged by its own text. Texts shorter than a window keep
all words; very long ones are treated whole. Words are told apart by 32-bit hashes, thus windows by 13 of them (or, below frequent
prefixes, by 128 bits); texts by 128 bits. An empty table gives an empty result. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, discard, free_shuffles, join_checked, join_hot, materialize, mix64, read_table, slices, text_buffer, tokens

WINDOW, GRAM = 13, 6
#: Suffixes of a group; beyond it, its prefix is lengthened.
GROUP_ROWS = 20_000
#: One of so many documents is in the sample that tells frequent prefixes; those seen so often in it, at most MOST_FREQUENT.
SAMPLE, SEEN, MOST_FREQUENT = 64, 8, 50_000
#: Windows of a node that is broadcast, at least.
LEAST_HOT = 1000
#: Bytes of spans that may be broadcast.
SPAN_BYTES = 16 << 20
#: Suffixes that a task orders at a time, about.
CHUNK_ROWS = 40_000
_STEP = np.uint64(0x9FB21C651E98DF25)
_SUFFIX, _WINDOW, _SURE = 0, 1, 2


def _grams(h: np.ndarray, words: int, n: int, salt: int) -> np.ndarray:
    """The hash of `words` words from each of the first n positions."""
    out = np.full(n, salt, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            out = out * _STEP + h[k : k + n]
    return mix64(out)


def _windows(h: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, its anchor's first word (never falling), and the gram hash at each position."""
    n = len(h) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
    g = _grams(h, gram, len(h) - gram + 1, 1)
    best, off = g[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, window - gram + 1):
        less = g[k : k + n] < best
        best[less] = g[k : k + n][less]
        off[less] = k
    return whole, whole + off[whole], g


def _among(x: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether and where values are in an ascending array."""
    if not len(ordered):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x, at


def anchors(docs: DataFrame, window: int, gram: int, frequent: np.ndarray) -> DataFrame:
    """(gram, doc_id, rid, pos) of the anchors of docs(doc_id, rid, text). For all frequent grams of a row, one with pos -1 and a gram of its own."""
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("pos", pa.int32())])
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, _, doc, h = tokens(*text_buffer(part.column(2)), lower=False)
                _, anchor, g = _windows(h, doc, window, gram)
                at = np.unique(anchor)
                own = doc[at]
                often, _ = _among(g[at].view(np.int64), sent.value)
                some = np.unique(own[often])
                begin = np.searchsorted(doc, np.arange(part.num_rows))
                key = np.concatenate([g[at[~often]].view(np.int64), mix64(some.astype(np.uint64) + h[begin[some]]).view(np.int64)])
                pos = np.concatenate([at[~often] - begin[own[~often]], np.full(len(some), -1)])
                own = pa.array(np.concatenate([own[~often], some]))
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(own), part.column(1).take(own), pa.array(pos.astype(np.int32))], schema=schema)

    return docs.select("doc_id", "rid", "text").mapInArrow(run, "gram long, doc_id long, rid long, pos int")


def shared_positions(found: DataFrame, group_rows: int) -> DataFrame:
    """(doc_id, rid, pos, long) of the anchors whose gram is in several documents; long: whether its prefix is lengthened. found: sorted by gram, doc_id within partitions that hold whole grams."""
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("pos", pa.int32()), ("long", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last gram's rows so far, or none of them if it is known to be long
        long_gram = None

        def decided(c: list[np.ndarray], ended: bool) -> tuple[pa.RecordBatch, list[np.ndarray] | None]:
            nonlocal long_gram
            gram, doc, rid, pos = c
            new = np.ones(len(gram), bool)
            new[1:] = gram[1:] != gram[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(gram)))
            behind = first + size - 1
            many = (size > group_rows) | (gram[first] == long_gram if long_gram is not None else False)
            good = many | (doc[first] != doc[behind])
            rest = None
            if not ended:
                if many[-1]:
                    long_gram = gram[-1]
                else:
                    rest = [x[first[-1] :] for x in c]
                    good[-1] = False
                    long_gram = None
            keep = np.repeat(good, size) | ((pos < 0) & (np.repeat(np.arange(len(first)) < len(first) - (rest is not None), size)))
            return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(rid[keep]), pa.array(pos[keep]), pa.array(np.repeat(many, size)[keep])], schema=schema), rest

        for batch in batches:
            if batch.num_rows:
                c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
                out, held = decided([np.concatenate(x) for x in zip(held, c)] if held else c, False)
                yield out
        if held:
            yield decided(held, True)[0]

    return found.mapInArrow(run, "doc_id long, rid long, pos int, long boolean")


def frequent_grams(docs: DataFrame, window: int, gram: int, sample: int) -> np.ndarray:
    """Grams that several documents of a sample share and that are frequent in it."""
    some = docs.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(sample)) == 0)
    counts = anchors(some, window, gram, np.zeros(0, np.int64)).groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    rows = counts.where(F.col("n") >= SEEN).where("lo < hi").orderBy(F.col("n").desc(), "gram").limit(MOST_FREQUENT).select("gram").collect()
    return np.sort(np.array([r.gram for r in rows], np.int64))


def hot_nodes(docs: DataFrame, window: int, gram: int, frequent: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Windows below frequent prefixes that are hot, ascending, and the smallest doc_id of each."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("p", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, _, doc, h = tokens(*text_buffer(part.column(1)), lower=False)
                whole, anchor, g = _windows(h, doc, window, gram)
                at = whole[_among(g[anchor].view(np.int64), sent.value)[0]]
                p = _grams(h, window, max(0, len(h) - window + 1), 2)[at].view(np.int64)
                ids = part.column(0).to_numpy(zero_copy_only=False)[doc[at]]
                order = np.lexsort((ids, p))
                own, first, n = np.unique(p[order], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids[order][first]), pa.array(n)], schema=schema)

    nodes = materialize(docs.select("doc_id", "text").mapInArrow(run, "p long, doc_id long, n long").groupBy("p").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    rows = nodes.where(F.col("n") >= max(LEAST_HOT, total * share)).orderBy("p").collect()
    discard(nodes)
    return np.array([r.p for r in rows], np.int64), np.array([r.least for r in rows], np.int64)


def suffixes(docs: DataFrame, window: int, gram: int, frequent: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(kind, p, doc_id, rid, start, before, words) of docs(doc_id, rid, text, at, long): a row for each anchor in `at`, of a prefix p, with the words of its windows, `before` of them in front of it; and one for each window of lengthened prefixes.

    Windows that a hot node decides come without words: kind _SURE if they repeat; others not at all.
    """
    schema = pa.schema([("kind", pa.int8()), ("p", pa.int64()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("before", pa.int8()), ("words", pa.binary())])
    sent = docs.sparkSession.sparkContext.broadcast((frequent, *hot))

    def marked(lists: pa.Array, begin: np.ndarray, size: int) -> np.ndarray:
        mark = np.zeros(size + 1, bool)
        at = lists.flatten().to_numpy(zero_copy_only=False)
        mark[(np.repeat(begin, lists.value_lengths().to_numpy(zero_copy_only=False)) + at)[at >= 0]] = True
        return mark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hot, least = sent.value
        for batch in batches:
            for part in slices(batch, 1 << 20):
                _, _, doc, h = tokens(*text_buffer(part.column(2)), lower=False)
                whole, anchor, g = _windows(h, doc, window, gram)
                begin = np.searchsorted(doc, np.arange(part.num_rows))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                normal, long = marked(part.column(3), begin, len(h)), marked(part.column(4), begin, len(h))
                word = (h >> np.uint64(32)).astype("<u4")
                # a row for each anchor: its windows start one after the other
                own = normal[anchor]
                at, first, many = np.unique(anchor[own], return_index=True, return_counts=True)
                start = whole[own][first]
                size = many + window - 1
                end = np.cumsum(size)
                flat = word[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
                words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.append(0, end) * 4).astype(np.int32)), pa.py_buffer(flat)])
                rows = doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), _SUFFIX, np.int8)), pa.array(g[at].view(np.int64)), pa.array(ids[rows]), part.column(1).take(pa.array(rows)), pa.array((start - begin[rows]).astype(np.int32)), pa.array((at - start).astype(np.int8)), words], schema=schema)
                # a row for each window of a lengthened prefix
                at = whole[long[anchor] | _among(g[anchor].view(np.int64), frequent)[0]]
                n = max(0, len(h) - window + 1)
                p, check = _grams(h, window, n, 2)[at].view(np.int64), _grams(h, window, n, 5)[at]
                rows = doc[at]
                decided, where = _among(p, hot)
                sure = decided & (ids[rows] > least[where]) if len(hot) else decided
                keep = np.flatnonzero(sure | ~decided)
                at, p, check, rows, sure = at[keep], p[keep], check[keep], rows[keep], sure[keep]
                words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.append(0, np.cumsum(~sure)) * 8).astype(np.int32)), pa.py_buffer(check[~sure])])
                p = np.where(sure, mix64((ids[rows] + at).astype(np.uint64)).view(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(sure, _SURE, _WINDOW).astype(np.int8)), pa.array(p), pa.array(ids[rows]), part.column(1).take(pa.array(rows)), pa.array((at - begin[rows]).astype(np.int32)), pa.array(np.zeros(len(at), np.int8)), words], schema=schema)

    return docs.select("doc_id", "rid", "text", "at", "long").mapInArrow(run, "kind byte, p long, doc_id long, rid long, start int, before byte, words binary")


def tree_repeats(p: np.ndarray, doc: np.ndarray, before: np.ndarray, offsets: np.ndarray, flat: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each suffix a mask of its windows (bit k: that from k words behind its first) that also start in a smaller document. Groups p must be whole."""
    n, side = len(p), window - gram
    size = np.diff(offsets)
    rows = np.repeat(np.arange(n), size)
    words = np.zeros((n, side + window), np.uint32)  # the anchor begins in column `side`
    words[rows, np.arange(len(flat)) - np.repeat(offsets[:-1], size) + side - before[rows]] = flat
    right = size - before
    order = np.lexsort((*(words[:, side + k] for k in range(window - 1, -1, -1)), p))
    p, doc, before, right, words = p[order], doc[order], before[order], right[order], words[order]
    common = np.zeros(n + 1, np.int64)  # words that each suffix and the one before it begin with
    same = p[1:] == p[:-1]
    for k in range(window):
        same = same & (words[1:, side + k] == words[:-1, side + k]) & (right[1:] > k) & (right[:-1] > k)
        common[1:-1] += same
    mask = np.zeros(n, np.int64)
    left = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(side + 1):  # windows that start k words before the anchor
            if k:
                left = mix64(left * _STEP + words[:, side - k] + np.uint64(1))
            depth = window - k
            inner = (common[:-1] >= depth) | (common[1:] >= depth)
            at = np.flatnonzero(inner & (before >= k) & (right >= depth))
            if not len(at):
                continue
            node = np.cumsum(common[:-1] < depth)[at]
            by = np.lexsort((doc[at], left[at], node))
            at, node = at[by], node[by]
            new = np.ones(len(at), bool)
            new[1:] = (node[1:] != node[:-1]) | (left[at[1:]] != left[at[:-1]])
            smallest = doc[at][np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            again = doc[at] > smallest
            mask[at[again]] |= np.int64(1) << (before[at[again]] - k)
    out = np.zeros(n, np.int64)
    out[order] = mask
    return out


def subtree_repeats(groups: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, rid, start, mask) of the suffixes with repeated windows. groups: sorted by kind, p, doc_id within partitions that hold whole groups."""
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("mask", pa.int16())])

    def pack(batch: pa.Table, mask: np.ndarray) -> pa.RecordBatch:
        keep = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (2, 3, 4)] + [pa.array(mask[keep].astype(np.int16))], schema=schema)

    def whole(held: list[pa.RecordBatch], ended: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        """The repeats of the groups that are whole; what is left."""
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.to_batches()[0] if rows.num_rows else held[0]
        p = rows.column(1).to_numpy(zero_copy_only=False)
        cut = len(p) if ended else int(np.flatnonzero(np.append(True, p[1:] != p[:-1]))[-1])
        if not cut:
            return None, [rows]
        now = rows.slice(0, cut)
        words = now.column(6)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + cut + 1].astype(np.int64) // 4
        body = words.buffers()[2]
        flat = (np.frombuffer(body, "<u4", offsets[-1]) if body is not None else np.zeros(0, "<u4"))[offsets[0] :]
        doc, before = (now.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
        mask = tree_repeats(p[:cut], doc, before.astype(np.int64), offsets - offsets[0], flat, window, gram)
        return pack(now, mask), [rows.slice(cut)] if cut < len(p) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        node, least = None, 0
        for batch in batches:
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(kind, _WINDOW))
            if cut:
                held.append(batch.slice(0, cut))
            if held and (cut < len(kind) or sum(b.num_rows for b in held) >= CHUNK_ROWS):
                out, held = whole(held, cut < len(kind))
                if out is not None:
                    yield out
            if cut == len(kind):
                continue
            rest = batch.slice(cut)
            sure = kind[cut:] == _SURE
            p, doc = (rest.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            check = np.array([int.from_bytes(x, "little") for x in rest.column(6).to_pylist()], np.uint64)
            new = np.ones(len(p), bool)  # one node of full depth each: the smallest doc_id comes first
            new[1:] = (p[1:] != p[:-1]) | (check[1:] != check[:-1]) | sure[1:]
            smallest = doc[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
            if node == (p[0], check[0]) and not sure[0]:
                upto = np.flatnonzero(new[1:])[0] + 1 if new[1:].any() else len(p)
                smallest[:upto] = least
            node, least = (p[-1], check[-1]), smallest[-1]
            yield pack(rest, (sure | (doc > smallest)).astype(np.int64))
        if held:
            yield whole(held, True)[0]

    return groups.mapInArrow(run, "doc_id long, rid long, start int, mask short")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, rid) of the rows whose whole text also is one of a smaller doc_id."""
    rows = materialize(docs.select("doc_id", "rid", F.xxhash64(F.lit(7), "text").alias("other")), "text-ids")
    same = rows.groupBy("rid").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"), F.min("other").alias("a"), F.max("other").alias("b"))
    same = materialize(same.where("least < most and a = b").select("rid", "least", "n"), "equal-texts")
    return materialize(join_hot(rows, same, "rid", "n", rows.count()).where("doc_id > least").select("doc_id", "rid").distinct(), "copies")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS, share: float = HOT_SHARE, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, rid, whole, spans): for each row of docs(doc_id, rid, text) that has some, whether it is a copy (all its words go if it has a window), or else the maximal runs [first, behind) of words in windows that also start in a smaller doc_id."""
    docs = docs.where("doc_id is not null and text is not null")
    same = copies(docs)
    frequent = frequent_grams(docs, window, gram, sample)
    found = anchors(docs, window, gram, frequent).repartition("gram").sortWithinPartitions("gram", "doc_id")
    met = shared_positions(found, group_rows)
    at = met.groupBy("doc_id", "rid").agg(F.collect_set(F.when(~F.col("long"), F.col("pos"))).alias("at"), F.collect_set(F.when(F.col("long"), F.col("pos"))).alias("long"))
    at = materialize(join_checked(at, same, ["doc_id", "rid"], "left_anti"), "positions")
    del found, met
    free_shuffles(docs.sparkSession)
    hot = hot_nodes(docs, window, gram, frequent, share) if len(frequent) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    free_shuffles(docs.sparkSession)
    placed = docs.join(at.hint("merge"), ["doc_id", "rid"])
    groups = suffixes(placed, window, gram, frequent, hot).repartition("p").sortWithinPartitions("kind", "p", "doc_id")
    starts = subtree_repeats(groups, window, gram).groupBy("doc_id", "rid").agg(F.collect_set(F.col("start") * 65536 + F.col("mask").cast("long")).alias("at"))
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("whole", pa.bool_()), ("spans", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(window - gram + 1)
        for batch in batches:
            spans = []
            for codes in batch.column(2):
                x = codes.values.to_numpy(zero_copy_only=False)
                s = np.unique(((x >> 16)[:, None] + bits)[(x[:, None] >> bits) & 1 == 1])
                cut = np.flatnonzero(np.diff(s) > window)
                spans.append(np.stack([s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]] + window], 1).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(len(spans), bool)), pa.array(spans, pa.binary())], schema=schema)

    spans = starts.mapInArrow(run, "doc_id long, rid long, whole boolean, spans binary")
    spans = materialize(spans.unionByName(same.select("doc_id", "rid", F.lit(True).alias("whole"), F.lit(b"").alias("spans"))), "spans")
    discard(at)
    del groups, starts, placed
    free_shuffles(docs.sparkSession)
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("rid"), "text")


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of docs(doc_id, text) and, if wanted, kept_text and the spans [first, behind) removed."""
    docs = keyed(docs)
    spans = repeats(docs, window)
    size, rows = spans.agg(F.sum(F.length("spans") + 32), F.count("*")).first()
    joined = join_checked(docs, spans, ["doc_id", "rid"], "left", 0 if (size or 0) <= SPAN_BYTES else 1, 0).select("doc_id", "text", "spans", "whole")
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                total, gone, shas, kept, lists = [], [], [], [], []
                for text, spans, whole in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
                    words = (text or "").encode().split()
                    total.append(len(words))
                    cut = [[0, len(words)]] * (len(words) >= window) if whole else np.frombuffer(spans or b"", "<i4").reshape(-1, 2).tolist()
                    left, at = [], 0
                    for a, b in cut:
                        left += words[at:a]
                        at = b
                    left += words[at:]
                    gone.append(len(words) - len(left))
                    body = b" ".join(left)
                    shas.append(hashlib.sha256(body).hexdigest())
                    if texts:
                        kept.append(body.decode())
                        lists.append(cut)
                columns = [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
                if texts:
                    columns += [pa.array(kept, pa.string()), pa.array(lists, fields[-1][1])]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<array<int>>" * texts)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS at FROM windows JOIN firsts USING (k), range(13) r(j) WHERE doc_id > least),
kept AS (SELECT x.doc_id, x.i, x.word FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words) x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.at = x.i)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM words d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body FROM kept GROUP BY doc_id) k ON k.doc_id = d.doc_id
"""
QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES = {"op6_substring_dedup": SQL}
