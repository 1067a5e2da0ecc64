"""LM scoring, quality, HTML and fingerprints."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from offerlens.llm import fingerprints, html_text, lm_score, quality
from offerlens.llm.common import crc_mod, mix64, tokens

END = object()


def brute_base(rows):
    counts, words = Counter(), []
    for r in rows:
        w = (r[1] or "").encode().lower().split() + [END]
        held = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2
        words.append((r[0], held, w))
        if not held:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return [(i, held, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, held, w in words]


@pytest.mark.parametrize("warm", [400_000, 3])
def test_lm_base_scores_equal_brute_force(docs, rows, monkeypatch, warm):
    """Also with nearly all words joined instead of broadcast."""
    monkeypatch.setattr(lm_score, "WARM", warm)
    monkeypatch.setattr(lm_score.vocabulary, "__defaults__", (warm,))
    plain = docs.select("doc_id", "text")
    got = lm_score.lm_scores(plain, plain.where(crc_mod("doc_id", 7) != 2)).collect()
    want = Counter((*x[:1], *x[2:5], round(x[5], 6)) for x in brute_base(rows))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def small_model():
    rng = np.random.default_rng(4)
    head = mix64(np.arange(1, lm_score.HEAD + 1, dtype=np.uint64))
    order = np.argsort(head)
    v = lm_score.Vocabulary(head[order], order, np.sort(rng.integers(1, 900, lm_score.HEAD))[::-1].astype(float), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.full(lm_score.TAILS, 50.0), np.full(lm_score.TAILS, 9.0), 10_000, 900)
    return lm_score.MaxEnt.from_counts(v)


def test_lm_distribution_sums_to_one_after_training():
    model = small_model()
    rng = np.random.default_rng(5)
    t = np.unique((rng.integers(0, lm_score.START, 3000) << 22) | (rng.integers(0, lm_score.START, 3000) << 11) | rng.integers(0, lm_score.HEAD + lm_score.TAILS, 3000))
    assert model.bits == 11
    model.learn(t, np.ones(len(t)), 1)
    for context in ((3, 9), (lm_score.START, lm_score.START), (270, 5)):
        every = (context[0] << 22) | (context[1] << 11) | np.arange(lm_score.HEAD + lm_score.TAILS)
        assert math.isclose((10 ** model.log10(every)).sum(), 1, rel_tol=1e-4)


def test_lm_steps_follow_the_gradient():
    """One step without what Adagrad remembers moves each row by the sign of its gradient, summed over repeated contexts and targets."""
    rng = np.random.default_rng(9)
    w, squares = np.zeros((5, 4), np.float32), np.full((5, 4), 1e-30, np.float32)
    at, target, weight = np.array([0, 0, 1, 1, 1]), np.array([2, 2, 0, 3, 3]), rng.random(5).astype(np.float32)
    rows = [np.array([0, 1]), np.array([2, 2])]
    p = rng.random((2, 4))
    p /= p.sum(1, keepdims=True)
    g = np.zeros((2, 4))
    for i in range(5):
        g[at[i]] -= weight[i] * p[at[i]]
        g[at[i], target[i]] += weight[i]
    lm_score.MaxEnt._step(w, squares, rows, np.log(p).astype(np.float32), at, target, weight)
    want = np.zeros((5, 4))
    want[0], want[1] = np.sign(g[0]), np.sign(g[1])
    want[2] = np.sign(g[0] + g[1])
    assert np.allclose(w, lm_score.RATE * want, atol=1e-3)


def test_lm_steps_use_their_memory_again():
    """A step's arrays were fresh ones, which took most of its time. Sums of rows by pairs equal plain ones."""
    rng = np.random.default_rng(3)
    w, squares = np.zeros((2000, 64), np.float32), np.full((2000, 64), 1e-8, np.float32)
    rows = [np.minimum(rng.zipf(1.3, 6000), 1999), rng.integers(0, 2000, 6000)]
    at, target, weight = np.sort(rng.integers(0, 6000, 8192)), rng.integers(0, 64, 8192), rng.random(8192).astype(np.float32)
    log = np.full((6000, 64), -math.log(64), np.float32)
    g = -np.bincount(at, weight, 6000)[:, None] * np.exp(log.astype(float))
    np.add.at(g, (at, target), weight)
    sums = np.zeros((2000, 64))
    np.add.at(sums, rows[0], g)
    order = np.argsort(rows[0], kind="stable")
    own, first = np.unique(rows[0][order], return_index=True)
    assert np.allclose(lm_score._segment_sums(g.astype(np.float32), order, first), sums[own], atol=1e-3)
    step = lambda: lm_score.MaxEnt._step(w, squares, rows, log.copy(), at, target, weight)
    step()
    tracemalloc.start()
    copy = log.copy()
    held, _ = tracemalloc.get_traced_memory()
    lm_score.MaxEnt._step(w, squares, rows, copy, at, target, weight)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most - held < log.nbytes


@pytest.mark.parametrize("warm", [400_000, 3])
def test_lm_scores_equal_brute_force(docs, rows, monkeypatch, warm):
    """Scores word by word from the trained weights: class, word in it, or a tail class and the count in it."""
    monkeypatch.setattr(lm_score, "WARM", warm)
    plain = docs.select("doc_id", "text")
    training = plain.where(crc_mod("doc_id", 7) != 2)
    counts = lm_score.materialize(lm_score._summed(training, lambda doc, h: h.view(np.int64), "key long, n long"), "counts")
    v = lm_score.vocabulary(counts, warm)
    model = lm_score.train(training, v)
    assert np.abs(model.class_w).max() > 0 and np.abs(model.word_w).max() > 0
    n = {np.int64(r.key).view(np.uint64): r.n for r in counts.collect()}
    hashed = lambda x, salt, rows: int(lm_score._hashed(np.array([x]), salt, rows)[0])

    def softmax(w, bias, context, salt):
        by = salt << (2 * model.bits + 2)
        x = bias.astype(float).copy()
        for k, f in enumerate((context & ((1 << model.bits) - 1), context >> model.bits, context), 1):
            x += w[hashed(f | by, k, model.rows)]
        x -= x.max()
        return x - math.log(np.exp(x).sum())

    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        _, h = lm_score.sequences(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        ids = v.find(h)
        start, total = model.head + lm_score.TAILS, 0.0
        if len(h) > 400:
            continue
        for i, (word, key) in enumerate(zip(ids.tolist(), h)):
            context = ((ids[i - 2] if i > 1 else start) << model.bits) | (ids[i - 1] if i else start)
            context = int(context)
            if word < model.head:
                c = word // model.per_class
                total += softmax(model.class_w, model.class_bias, context, 0)[c] + softmax(model.word_w, model.word_bias[c], context, c + 1)[word % model.per_class]
            else:
                t = word - model.head
                total += softmax(model.class_w, model.class_bias, context, 0)[model.classes + t] + math.log((n.get(key, 0) + 1) / (v.tail_tokens[t] + v.tail_words[t] + 1))
        want[r[0], len(h), round(total / math.log(10), 1)] += 1
    got = Counter((r.doc_id, r.n_tokens, r.score) for r in lm_score.scored(plain, counts, v, model).where("n_tokens <= 400").collect())
    assert len(got) == len(want) or sum(got.values()) == sum(want.values())
    for (a, b, x), (c, d, y) in zip(sorted(got.elements(), key=str), sorted(want.elements(), key=str)):
        assert (a, b) == (c, d)
    assert Counter((a, b) for a, b, _ in got.elements()) == Counter((a, b) for a, b, _ in want.elements())
    by_id = {}
    for a, b, x in got.elements():
        by_id.setdefault((a, b), []).append(x)
    for a, b, y in want.elements():
        assert any(abs(x - y) < 0.06 + 1e-4 * abs(y) for x in by_id[a, b]), (a, b, y, by_id[a, b])


def test_lm_learns_what_follows_what():
    model = small_model()
    t = np.array([(7 << 22) | (11 << 11) | 5, (8 << 22) | (12 << 11) | 200])
    before = model.log10(t)
    model.learn(np.repeat(t, 1), np.array([50.0, 50.0]), 1, epochs=20)
    assert (model.log10(t) > before + 0.5).all()


def test_lm_grows_with_the_counts(spark):
    made = lambda words: lm_score.vocabulary(spark.range(1, words + 1).selectExpr("xxhash64(id) as key", "1000 + id as n"))
    small, large = (lm_score.MaxEnt.from_counts(made(n)) for n in (300, 9000))
    assert (small.head, small.rows) == (lm_score.HEAD, lm_score.ROWS) and large.head == 25 * lm_score.HEAD and large.rows == 5 * lm_score.ROWS
    assert large.word_w.shape[1] * large.classes == large.head
    ids = np.array([4000, 5000, 6000, 4000, 5000, 6000])
    t = lm_score.triples(np.array([0, 0, 0, 1, 1, 1]), ids, large.head)
    before = large.log10(np.unique(t))
    large.learn(*np.unique(t, return_counts=True), 1, epochs=20)
    assert (large.log10(np.unique(t)) > before + 0.5).all()
    every = (t[2] >> large.bits << large.bits) | np.arange(large.head + lm_score.TAILS)
    assert math.isclose((10 ** large.log10(every)).sum(), 1, rel_tol=1e-4)


def test_lm_beats_the_base_on_held_out_text(spark):
    rng = random.Random(2)
    tongues = [["%s%d" % (c, i) for i in range(40)] for c in "abcd"]
    rows = [(i, " ".join(rng.choices(tongues[i % 4], k=80))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.lm_scores(docs, docs.where(crc_mod("doc_id", 7) != 2)).withColumn("held", crc_mod("doc_id", 7) == 2).where("held").agg(F.avg("score"), F.avg("base_score")).first()
    assert got[0] > got[1] + 20


def test_tokens_are_bytes_between_ascii_white_space():
    texts = ["A b\tc\x0b\x0cd\r\n e", "", " x ", "no\xa0break", "É", "é", "a" * 70000 + " b"]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    start, end, doc, h = tokens(np.frombuffer(b"".join(raw), np.uint8), bounds)
    data = b"".join(raw)
    assert [(d, data[s:e]) for s, e, d in zip(start, end, doc)] == [(i, w) for i, r in enumerate(raw) for w in r.split()]
    words = [w.lower() for r in raw for w in r.split()]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))


def test_quality_learns_labels_and_scores_all(spark, docs, rows, no_docs):
    rng = random.Random(3)
    good = [" ".join(rng.choices(["anth", "the", "of", "ering", "thand", "isto"], k=60)) + "." for _ in range(150)]
    bad = [" ".join(w + rng.choice(("%%%", "$$$", "!!")) for w in rng.choices(["anth", "the", "of", "ering"], k=60)) for _ in range(150)]
    every = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(1, None), (None, 1), (999, 1), (2, 7)], "doc_id long, quality int")
    held = crc_mod("doc_id", 3) == 1
    model = quality.train(every, quality.training_labels(labels))
    got = quality.scored(every, model).where(held).join(labels, "doc_id").where("quality in (0, 1)").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) >= 0.97 * len(got)
    assert quality.scored(docs, model).where("score between 0 and 1").count() == len(rows)
    kept = quality.good_rows(docs, model)
    assert kept.columns == docs.columns and quality.good_rows(no_docs, model).count() == 0
    assert quality.scored(no_docs, model).count() == 0


def test_quality_labels_that_repeat_count_once(spark):
    """300 more labels of one document push no other out of the sample and don't move the curve."""
    docs = spark.createDataFrame([(i, f"{'good' if i < 20 else 'bad'} words {i * i * 7919} of document {i}") for i in range(40)], "doc_id long, text string")
    plain = [(i, int(i < 20)) for i in range(40)]
    models = [quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"), sample_docs=50) for rows in (plain, plain + [(3, 1)] * 300)]
    assert models[0] == models[1]


def test_quality_evidence_and_curve_by_hand():
    """Sizes from zstandard's own calls with each dictionary; the curve has no better neighbour by its penalised likelihood."""
    rng = np.random.default_rng(4)
    good, bad = ([(" ".join(rng.choice(words, 40))).encode() for _ in range(90)] for words in (["alpha", "beta", "gamma"], ["delta!!", "beta", "omega$$"]))
    model = quality.fit(good, bad)
    held = [zstandard.ZstdCompressionDict(d) for d in (model.good, model.bad)]
    text = b" ".join(good[:5] + bad[:40])
    assert len(text) > 2 * quality.PIECE

    def size(d, x):
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_dict_id=False).compress(x))

    for t in (text, good[0], bad[1], b"x"):
        parts = [t[i : i + quality.PIECE] for i in range(0, len(t), quality.PIECE)]
        want = sum(size(held[1], p) - size(held[0], p) for p in parts) / len(t)
        assert abs(quality.Scorer(model).evidence(t) - want) <= 4 * len(parts) / len(t)  # a prepared dictionary may find a match more or less
    x = np.array([0.5, 0.2, -0.1, 0.3, -0.4, -0.2, 0.1, -0.3])
    y, w = np.array([1, 1, 1, 1, 0, 0, 0, 0.0]), np.array([1, 2, 1, 1, 3, 1, 1, 1.0])

    def loss(slope, base):
        scale = np.sqrt(np.average(x * x, weights=w))
        z = slope * x + base
        return float((w * (np.log1p(np.exp(z)) - y * z)).sum() + 5e-4 * ((slope * scale) ** 2 + base**2))

    slope, base = quality.logistic(x, y, w)
    assert all(loss(slope, base) <= loss(slope + a, base + b) for a in (-0.01, 0, 0.01) for b in (-0.01, 0, 0.01))


def test_quality_of_a_long_text_is_that_of_its_parts():
    rng = random.Random(6)
    stems = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(4000)]
    text = lambda k: " ".join(rng.choices(stems[2000 * k : 2000 * k + 2000], k=200)).encode()
    scorer = quality.Scorer(quality.fit([text(0) for _ in range(300)], [text(1) for _ in range(100)], (3.0, 0.5)))
    parts = [text(1) for _ in range(1000)]
    mean, whole = sum(map(scorer.evidence, parts)) / len(parts), scorer.evidence(b" ".join(parts))
    assert mean < 0 and abs(whole - mean) < 0.1 * abs(mean)
    assert scorer.score(b" ".join(parts)) < 0.05


def test_quality_sample_keeps_texts_behind_very_long_ones(spark):
    rng = random.Random(8)
    text = lambda k, n: " ".join(f"{rng.choice(('the', 'of', 'anth', 'isto'))}{'%$'[k]}{rng.randint(0, 99)}" for _ in range(n))
    order = [r.id for r in spark.range(60).orderBy(F.xxhash64(F.lit(quality.SEED), "id")).collect()]
    long_ones = {order[0], order[1]} | {next(i for i in order if i % 2 == q) for q in (0, 1)}
    docs = spark.createDataFrame([(i, text(i % 2, 40_000 if i in long_ones else 60)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample_bytes=100_000)
    assert model.good and model.bad
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in got)


def test_quality_text_bound():
    assert quality.text_bound({10: 3, 5000: 2}, 20_000) >= 5000
    assert quality.text_bound({10: 3, 50_000: 2, 10**9: 1}, 30_030) == 10_000
    assert quality.text_bound({50_000: 10}, 100) == quality.PIECE and quality.text_bound({}, 100) == quality.PIECE
    text = bytes(rng % 251 for rng in range(100_000))
    assert quality.spread(text, 100_000) == text and len(quality.spread(text, 10_240)) == 10_240


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, quality.train(docs, none)).collect()} == {0.5}
    some = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert quality.scored(docs, quality.train(docs, some)).first().score > 0.5


def test_html_nodes_and_texts_on_held_out_pages():
    model, right, total = html_text.default_model(), 0, 0
    for page in html_text.labelled_pages(80, seed=1234):
        tree = html_text.parse(page)
        label = [int((html_text._LABEL.search(a) or ("", "0"))[1]) for a in tree.attrs]
        tree.attrs = [html_text._LABEL.sub("", a) for a in tree.attrs]
        p, _ = model.marginals(tree.parent, html_text.features(tree))
        right += sum((x >= 0.5) == bool(y) for x, y, c in zip(p, label, tree.chars) if c)
        total += sum(c > 0 for c in tree.chars)
    assert right >= 0.97 * total


def test_html_marginals_equal_enumeration():
    model = html_text.train(html_text.labelled_pages(20), epochs=2)
    tree = html_text.parse("<body><nav><ul><li><a href=x>m</a></li></ul></nav><article><p>Some text, of words.</p></article></body>")
    f, n = html_text.features(tree), len(tree.tag)
    weights = np.zeros((2,) * n)
    for labels in np.ndindex(*weights.shape):
        s = sum(model.own[k] for i in range(n) if labels[i] for k in f[i][0])
        s += sum(model.between[f[i][1]][2 * labels[tree.parent[i]] + labels[i]] for i in range(1, n))
        weights[labels] = math.exp(s)
    weights /= weights.sum()
    p, joint = model.marginals(tree.parent, f, edges=True)
    for i in range(n):
        assert math.isclose(p[i], weights.take(1, axis=i).sum(), rel_tol=1e-6, abs_tol=1e-9)
    assert all(math.isclose(sum(j), 1, rel_tol=1e-6) for j in joint[1:])


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just text", "just text"),
    ("<html><body><nav><a href=/>Menu</a></nav><article><h1>A &amp; B</h1><p>One\n two<b> three</b><p>Fo&uuml;r.<script>x<p></script></article><footer>end</footer></body></html>", "A & B\nOne two three\nFoür."),
    ("<article><p>Cut off text with words, and more of it.</p><p>then <b", "Cut off text with words, and more of it.\nthen"),
])
def test_html_cases(page, text):
    assert html_text.extract(page, html_text.default_model()) == text


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article><p>Words of a text, enough of them.</p></article>", "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extracted(pages, html_text.default_model()).collect()}
    assert got[1].text == "" and got[1].n_chars == 0 and got[2].text == "Words of a text, enough of them." and got[2].n_chars == 32
    assert html_text.extracted(pages.limit(0), html_text.default_model()).count() == 0


def test_fingerprints_equal_brute_force(docs, rows, no_docs, monkeypatch):
    by_hash = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), by_hash[r[1] or ""], r[1] or ""))
    want = Counter()
    for k, r in enumerate(ordered):
        text, following = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        f, g = fingerprints.fingerprint(text), fingerprints.fingerprint(changed)
        want[r[0], len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.as_text(f), fingerprints.as_text(g), fingerprints.likeness(f, g), fingerprints.likeness(f, fingerprints.fingerprint(following))] += 1
    for size in (2000, 7):
        monkeypatch.setattr(fingerprints.in_ranges, "__defaults__", (size,))
        assert Counter(map(tuple, fingerprints.fingerprints(docs).collect())) == want
    assert fingerprints.fingerprints(no_docs).count() == 0


def test_syncmers_depend_on_their_k_mer_alone():
    rng = random.Random(1)
    a = "".join(rng.choices("abcdefgh ", k=300))
    b = "zzzz" + a[40:200] + "qqqqqqqq"
    k = fingerprints.K
    at = lambda t: {t[p : p + k] for p in fingerprints.syncmers(fingerprints.code_points(t))[1]}
    inner = {a[i : i + k] for i in range(40, 200 - k + 1)}
    assert at(a) & inner == at(b) & inner != set()
    f = fingerprints.fingerprint(a)
    back = fingerprints.from_text(fingerprints.as_text(f))
    assert (back[0] == f[0]).all() and (back[1] == f[1]).all()
    assert fingerprints.likeness(f, fingerprints.fingerprint(a)) == 1.0 and fingerprints.likeness(f, fingerprints.fingerprint("")) == 0.0


def test_likeness_survives_insertions_and_finds_passages_in_long_texts():
    rng = random.Random(3)
    made = lambda n: ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n)]
    w = made(20_000)
    more = list(w)
    for at in (15_000, 9_000, 2_000):
        more.insert(at, "inserted")
    of = lambda words: fingerprints.fingerprint(" ".join(words))
    f = of(w)
    assert fingerprints.likeness(f, of(more)) > 0.99
    half = fingerprints.likeness(f, of(w[:10_000] + made(10_000)))
    assert abs(half - 1 / 3) < 0.01
    passage = made(50)
    a, b = of(made(9_000) + passage + made(9_000)), of(made(5_000) + passage + made(12_000))
    assert fingerprints.likeness(a, b) > 0 and fingerprints.likeness(of(w[:9_000]), of(made(9_000))) == 0


def test_likeness_is_near_the_share_of_common_k_mers():
    """Against an exact Jaccard similarity of all k-mers."""
    rng = random.Random(4)
    k = fingerprints.K
    for share in (0.02, 0.1, 0.3):
        a = "".join(rng.choices("abcdefgh ", k=20_000))
        b = list(a)
        for _ in range(int(share * 20_000 / k)):
            b[rng.randrange(len(b))] = "z"
        b = "".join(b)
        x, y = ({t[i : i + k] for i in range(len(t) - k + 1)} for t in (a, b))
        assert abs(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) - len(x & y) / len(x | y)) < 0.05


LINE = "One long sentence, with words and stops, that goes on."


@pytest.mark.parametrize("inside", ["<select><option>a<option>b", "<button>go", "<svg>", "<template>", "<textarea>typed", "<title>again", "<noscript>none"])
def test_html_unclosed_hidden_elements_hide_nothing_else(inside):
    page = f"<article><h1>Title</h1><p>{LINE}</p>{inside}<p>Two. {LINE}</p><p>Three. {LINE}</p></article><button>end</button>"
    assert html_text.extract(page, html_text.default_model()) == f"Title\n{LINE}\nTwo. {LINE}\nThree. {LINE}"


def test_html_hidden_elements_and_odd_attributes():
    page = f"<head><title>t</title><script>var a = '<p>';</script></head><article><svg><svg>a</svg>b</svg><p title='a>b' x=\"<p>\">{LINE}</p><select><option>a</select><object data=x>Fall back.</object><button><div>no</div></button></article>"
    assert html_text.extract(page, html_text.default_model()) == f"{LINE}\nFall back."


@pytest.mark.parametrize("made", [lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: '<a "' * n, lambda n: "<button>x" * n, lambda n: "<b><div>" * n + "</b>" * n, lambda n: '<a "<a "' * n + "<a ' >", lambda n: "<ul><div>" * n + "<li>" * n])
def test_html_time_is_in_proportion(made):
    import time

    took = []
    for n in (2_000, 16_000):
        text, began = made(n), time.thread_time()
        html_text.parse(text)
        took.append(time.thread_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)


def test_html_trains_on_a_table(spark):
    pages = spark.createDataFrame([(p,) for p in html_text.labelled_pages(30)] + [(None,)], "html string")
    model = html_text.train_on(pages)
    assert any(model.own) and model.own == html_text.train_on(pages).own
