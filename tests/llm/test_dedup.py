"""Exact dedup, near dedup and substring dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlens.llm import exact_dedup, graph, near_dedup, substring_dedup
from offerlens.llm.common import BATCH_BYTES, materialize, read_table
from offerlens.llm.graph import components


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        f = exact_dedup.BinaryFuse.build(keys)
        assert f.contains(keys).all()
        others = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
        assert f.contains(others).mean() < 0.001


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((r[0], keep[r[1] or ""], len(groups[r[1] or ""]), r[0] == keep[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)


def test_exact_equals_brute_force(docs, rows):
    got = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    assert Counter(map(tuple, got.collect())) == brute_exact(rows)


def test_exact_survives_digest_collisions(docs, rows):
    weak = lambda t: F.encode(F.lpad(F.pmod(F.crc32(t.cast("binary")), F.lit(5)).cast("string"), 9, "0"), "UTF-8")
    got = exact_dedup.exact_dedup(docs, digest=weak, shard_keys=3)
    want = Counter(k[:4] for k in brute_exact(rows).elements())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want


def test_exact_of_many_rows_without_ids(spark):
    """A third of all rows has no doc_id and one text; the weak digest makes it meet others."""
    rows = [(None, "same")] * 40 + [(None, f"t{i % 7}") for i in range(20)] + [(i, f"t{i % 11}") for i in range(60)]
    weak = lambda t: F.encode(F.lpad(F.pmod(F.crc32(t.cast("binary")), F.lit(3)).cast("string"), 9, "0"), "UTF-8")
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=weak)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == Counter(k[:4] for k in brute_exact(rows).elements())


def test_a_large_batch_meets_copies_of_one_filter(spark):
    """Parts of a batch change nothing in what the filter says."""
    old = exact_dedup.take_snapshot(exact_dedup.digests(spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))))
    batch = exact_dedup._grouped(exact_dedup.digests(spark.range(200, 900).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))))
    one, many = ({bytes(r.digest): r.maybe for r in exact_dedup.screen(batch, old, n).collect()} for n in (10_000, 16))
    assert len(one) == 700 and one == many and sum(one.values()) in range(100, 110)


def test_a_stored_snapshot_screens_a_batch(spark, docs, rows, tmp_path):
    old, new = docs.where("doc_id % 2 = 0"), docs.where("doc_id is null or doc_id % 2 = 1")
    path = f"file://{tmp_path}/snapshot"
    exact_dedup.take_snapshot(exact_dedup.digests(old), shard_keys=20, path=path)
    snapshot = exact_dedup.open_snapshot(spark, path)
    assert snapshot.shards > 1
    stays = {}
    for r in rows:
        if r[0] is not None and r[0] % 2 == 0:
            stays[r[1] or ""] = max(r[0], stays.get(r[1] or "", r[0]))
    want = Counter((r[0], stays.get(r[1] or "")) for r in rows if r[0] is None or r[0] % 2)
    got = exact_dedup.known_texts(new, snapshot, old).collect()
    assert Counter((r.doc_id, r.known_id) for r in got) == want


def test_exact_rows(docs, rows):
    kept = exact_dedup.dedup_rows(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len(got) == len({r[1] or "" for r in rows})
    assert {r.text or "" for r in got} == {r[1] or "" for r in rows}


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute_near(rows, n, percent=80):
    """The smallest id reachable from each (id, text); equal ids with different texts are linked only if the texts are."""
    sets = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
    sets = [(k, k[0], shingles(k[1], n)) for k in sets]
    root = {k: k for k, _, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, _, x) in enumerate(sets):
        for j, _, y in sets[:k]:
            met = len(x & y)
            if x and y and 100 * met >= percent * (len(x) + len(y) - met):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {k: find(k)[0] for k in root}


@pytest.mark.parametrize("n", [2, 5])
def test_near_equals_brute_force(docs, rows, n):
    root = brute_near(rows, n)
    want = Counter()
    for r in rows:
        size = len(shingles(r[1], n))
        to = root[r[0], r[1] or ""] if size and r[0] is not None else r[0]
        want[r[0], size, to, r[0] == to] += 1
    got = near_dedup.near_dedup(docs, words=n).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def linked_families(rng, families, members, size, heavy):
    """Families of texts around one base whose links hang on few words; `heavy`: edits of a family."""
    base = ["b%d" % i for i in range(size)]
    texts = []
    for family in range(families):
        edits = {rng.randrange(size): f"f{family}_{k}" for k in range(rng.choice(heavy))}
        for _ in range(members):
            w = [edits.get(i, x) for i, x in enumerate(base)]
            for _ in range(rng.randint(0, 5)):
                if rng.random() < 0.5:
                    w[rng.randrange(len(w))] = rng.choice((f"m{rng.random()}", "of", "the"))
                else:
                    del w[rng.randrange(len(w))]
            if rng.random() < 0.2:
                w = w[: rng.randint(size // 2, size)]
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "seed"), [(2, 1), (5, 2)])
def test_near_components_of_a_hot_group(spark, n, seed):
    """900 texts around the threshold in one group: components equal brute force."""
    import random

    rows = linked_families(random.Random(seed), 30, 30, 120, (0, 3, 8, 12, 20))
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=n).collect()}
    assert got == {k[0]: v for k, v in brute_near(rows, n).items()}


def test_sql_of_near_and_substrings(spark):
    """The registered SQL gives what the queries give."""
    import os

    import duckdb

    base = "/root/testdata/sf0.001"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{base}/documents.parquet'")
    for module in (near_dedup, substring_dedup):
        (name, query), sql = next(iter(module.QUERIES.items())), next(iter(module.ORACLES.values()))
        df = query(spark, base)
        want = db.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall()
        assert Counter(map(tuple, df.collect())) == Counter(want), name


def test_near_links_around_a_pivot_are_all_found(spark):
    """A hot group of near copies that are partly linked with each other only: no link between classes is lost."""
    import random

    rng = random.Random(11)
    base = ["b%d" % i for i in range(120)]
    texts = []
    for family in range(12):
        edits = {rng.randrange(120): f"f{family}_{k}" for k in range(rng.choice((0, 6, 11, 14)))}
        for member in range(10):
            w = [edits.get(i, x) for i, x in enumerate(base)]
            for _ in range(rng.randint(0, 4)):
                if rng.random() < 0.5:
                    w[rng.randrange(len(w))] = f"m{rng.random()}"
                else:
                    del w[rng.randrange(len(w))]
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = {k[0]: v for k, v in brute_near(rows, 2).items()}
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == want


def near_rows(rows):
    """What stays of rows: one of each group, all without words or id."""
    roots = brute_near(rows, 5)
    given = Counter((r[0], r[1] or "") for r in rows)
    return Counter({k: n if k[0] is None or not shingles(k[1], 5) else 1 for k, n in given.items() if k[0] is None or roots[k] == k[0]})


def test_near_rows(docs, rows):
    kept = near_dedup.near_dedup_rows(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == near_rows(rows)


@pytest.mark.parametrize("most", [0, 500_000])
def test_components_of_a_chain(spark, most):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = {r.node: r.component for r in components(edges, most).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("most", [0, 500_000])
def test_components_of_a_star_with_a_tail(spark, most):
    """A node with nearly all edges, whose label nearly all nodes get; ties, repeated edges and edges both ways."""
    edges = [(500, i) for i in range(501, 900)] + [(501, 500), (501, 500), (899, 1000), (1000, 1001), (1001, 7), (2001, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), most).collect()}
    assert got == {**{i: 7 for i in (7, *range(500, 900), 1000, 1001)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long"), most).count() == 0


def test_small_tables_of_components_are_not_a_file_for_each_partition(spark, monkeypatch):
    """As they were with a fixed number of shuffle partitions: each turn then started that many tasks for a few rows."""
    made = []
    monkeypatch.setattr(graph, "materialize", lambda df, tag, *a: made.append((tag, materialize(df, tag, *a))) or made[-1][1])
    files = []
    monkeypatch.setattr(graph, "discard", lambda *tables: files.extend(len(t.inputFiles()) for t in tables))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, x in held.items():
            spark.conf.set(k, x)
        pairs = spark.range(300).selectExpr("id as a", "id - id % 3 as b").where("a != b").coalesce(1)
        assert {(r.node, r.component) for r in components(pairs).collect()} == {(i, i - i % 3) for i in range(300)}
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert max(files) <= 2 and all(tag in ("edges", "labels") for tag, _ in made)


def brute_substring(rows, window=13):
    first = {}
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for i, w in words:
        for k in range(len(w) - window + 1) if i is not None else ():
            t = tuple(w[k : k + window])
            first[t] = min(first.get(t, i), i)
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(left).hexdigest()] += 1
    return out


def test_substrings_equal_brute_force(docs, rows, monkeypatch):
    want = brute_substring(rows)
    plain = substring_dedup.repeats
    # as in production; with lengthened prefixes; with frequent prefixes known from a sample and hot nodes broadcast; with small chunks
    for k, kw in enumerate(({}, {"group_rows": 3}, {"sample": 1, "share": 0.0}, {"sample": 2, "group_rows": 5})):
        monkeypatch.setattr(substring_dedup, "repeats", lambda d, w, kw=kw: plain(d, w, **kw))
        got = substring_dedup.substring_dedup(docs, texts=k == 0)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
        monkeypatch.setattr(substring_dedup, "SEEN", 2)
        monkeypatch.setattr(substring_dedup, "LEAST_HOT", 2)
        monkeypatch.setattr(substring_dedup, "CHUNK_ROWS", 10)


def test_subtree_nodes_equal_brute_force():
    """Each suffix's windows that also start in a smaller document, from ordered suffixes and their common prefixes."""
    rng = np.random.default_rng(2)
    window, gram = 6, 3
    docs = [rng.integers(0, 3, rng.integers(6, 40)) for _ in range(12)]
    first = {}
    for d, w in enumerate(docs):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    p, doc, before, words, where = [], [], [], [], []
    for d, w in enumerate(docs):
        for a in range(len(w) - gram + 1):  # every place as an anchor, with all windows around it
            lo, hi = max(0, a - (window - gram)), min(a, len(w) - window)
            if lo <= hi:
                p.append(hash(tuple(w[a : a + gram])) & 0xFFFF)
                doc.append(d), before.append(a - lo), words.append(w[lo : hi + window]), where.append((d, lo, hi))
    order = np.argsort(np.array(p), kind="stable")
    flat = np.concatenate([words[i] for i in order]).astype(np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(words[i]) for i in order])])
    mask = substring_dedup.tree_repeats(np.array(p, np.int64)[order], np.array(doc, np.int64)[order], np.array(before, np.int64)[order], offsets, flat, window, gram)
    for i, m in zip(order, mask):
        d, lo, hi = where[i]
        assert int(m) == sum(1 << (s - lo) for s in range(lo, hi + 1) if first[tuple(docs[d][s : s + window])] < d)


def test_empty_tables(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.dedup_rows(no_docs).count() == 0
    assert near_dedup.near_dedup(no_docs).count() == 0
    assert near_dedup.near_dedup_rows(no_docs).count() == 0
    assert substring_dedup.substring_dedup(no_docs).count() == 0


@pytest.mark.parametrize("given, left", [("64m", "2097152"), ("1g", "2097152"), ("2097153b", "2097152"), ("2mb", "2mb"), ("65536", "65536")])
def test_python_gets_long_texts_by_bytes(spark, tmp_path, given, left):
    """A batch of 10,000 long texts would be as large as they are, in the JVM's and in Python's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 500).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, given)
        docs = read_table(spark, str(tmp_path), "documents")
        assert spark.conf.get(name) == left
        sizes = [r.n for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
        assert sum(sizes) > 2000 * 5500 and max(sizes) < BATCH_BYTES + 6000
        spark.conf.set(name, given)
        materialize(docs.limit(1), "few")
        assert spark.conf.get(name) == left
    finally:
        spark.conf.set(name, before)


def test_near_equals_itself_in_small_batches(spark, docs):
    """Where batches end changes nothing."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    found = []
    try:
        for most in ("2m", "3000"):
            spark.conf.set(name, most)
            found.append(Counter(map(tuple, near_dedup.near_dedup(docs, words=2).collect())))
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1]
