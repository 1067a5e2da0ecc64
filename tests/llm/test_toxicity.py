"""Toxic passages: segments against their definition, scores word by word, held-out accuracy, defined cases."""

import math
import random
import re

import pytest

from offerlens.llm import toxicity as T

SCHEMA = "doc_id long, text string, score double, evidence int, fold int"
LABELS = "doc_id long, quality int, toxic int, text string"


def brute_segments(scores):
    """Maximal scoring subsequences by their definition: the best of the whole (shortest, then first), then the same to its left and right."""
    def find(lo, hi):
        best = max(((round(sum(scores[i:j]), 9), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return find(lo, i) + [(i, j - 1, best[0])] + find(j, hi)

    return find(0, len(scores))


def test_segments_equal_their_definition():
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.choice((-0.2, -0.2, -0.2, rng.uniform(0.1, 2))) for _ in range(rng.randint(0, 22))]
        got = T.segments([(i, s) for i, s in enumerate(scores) if s > 0])
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(math.isclose(x[2], y[2], abs_tol=1e-6) for x, y in zip(got, want))


def test_segments_are_found_in_linear_time():
    rng = random.Random(4)
    T.segments([(3 * i + rng.randint(0, 1), rng.uniform(0.01, 3)) for i in range(300_000)])
    T.segments([(i * 10, 1 + i * 1e-6) for i in range(300_000)])


def corpus(n=400, seed=5):
    """Toxic texts have a bad word in some place; its ending is new in a tenth of them."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("lo", "ma", "ti", "ser") for b in ("na", "pel", "rint", "qua", "dov")]
    bad, docs, labels = ["grumblest", "grumblor", "zorken", "vilefax"], [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 400))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) if rng.random() < 0.9 else f"grumbl{i}" for _ in range(4)]
        docs.append((i, " ".join(words).capitalize() + ".", None, 1, 2))
        labels.append((i, 1, toxic, "x"))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus()
    extra = [(900, None, None, 0, 0), (901, "", None, 0, 0), (None, "Zorken zorken!", None, 0, 0), (902, "lona mapel " * 60_000 + "zorken vilefax grumblor zorken", None, 0, 0)]
    other = [(900, 1, 1, "x"), (901, 1, None, "x"), (None, 1, 1, "x"), (5000, 1, 1, "x"), (3, 1, 7, "x"), labels[0], labels[0]]
    table, marks = spark.createDataFrame(docs + extra + [docs[1], docs[1]], SCHEMA).repartition(3), spark.createDataFrame(labels + other, LABELS)
    return docs, {i: t for i, _, t, _ in labels}, table, T.train(table, T.training_labels(marks))


def test_held_out_accuracy(trained):
    docs, toxic, table, model = trained
    got = {r.doc_id: r for r in T.scored(table, model).withColumn("held", T.crc_mod("doc_id", 3) == 1).collect()}
    held = [i for i in toxic if got[i].held]
    assert len(held) > 100
    assert sum((got[i].score >= 0.7) != (toxic[i] == 1) for i in held) <= 0.03 * len(held)
    assert got[902].score >= 0.5 and got[900].score == got[901].score < 0.3


def test_scores_equal_a_word_by_word_computation(trained):
    docs, _, table, model = trained
    got = {r.doc_id: r for r in T.scored(table, model).collect()}
    for i, text, *_ in docs[:60]:
        words = re.findall(r"[^\W_]+", text.lower())
        scores = []
        for k, w in enumerate(words):
            s = -T.DRIFT
            for b in [w[:n] for n in range(3, min(len(w), 9))] + [w + " "]:
                s = model.scores.get(b, s)
            scores.append(-T.DRIFT if k and words[k - 1] == w else s)
        best = sorted((s for *_, s in T.segments([(k, s) for k, s in enumerate(scores) if s > 0])), reverse=True) or [0.0]
        normal = [model.decay * s - model.log_k - math.log(len(words)) for s in best]
        evidence = max(sum(normal[: r + 1]) - math.lgamma(r + 2) for r in range(len(normal)))
        assert math.isclose(got[i].evidence, evidence, rel_tol=1e-9, abs_tol=1e-9)
        z = model.curve[0] * min(max(evidence, -30), 30) + model.curve[1] * math.log(len(words)) + model.curve[2]
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_passages_hold_the_bad_words(trained):
    docs, toxic, table, model = trained
    found = T.passages(table, model).collect()
    texts = {i: t for i, t, *_ in docs}
    for r in found:
        if r.doc_id in texts:
            assert r.text == texts[r.doc_id][r.first : r.end]
            assert toxic[r.doc_id] and re.search("grumbl|zorken|vilefax", r.text.lower())
    assert any(r.doc_id == 902 and r.text.startswith("zorken") for r in found)


def test_counts_back_off_along_beginnings():
    scores = T.build({"zor": (1, 40), "zorken ": (0, 30), "zorka ": (0, 10), "ple": (300, 12), "plenty ": (2, 9)}, (1000, 100))
    assert scores["zorken "] > 3 and scores["zor"] > 3 and "ple" not in scores
    assert T.Scorer(T.Model(scores)).word("zornew") == scores["zor"] and T.Scorer(T.Model(scores)).word("lorem") == -T.DRIFT


def test_decay_is_the_root():
    from collections import Counter

    tally = Counter({-0.2: 9000, 2.0: 100, 4.0: 5})
    d = T.decay_of(tally)
    assert d > 0 and math.isclose(sum(n * math.exp(d * s) for s, n in tally.items()) / sum(tally.values()), 1, rel_tol=1e-6)
    assert T.decay_of(Counter()) == T.decay_of(Counter({-0.2: 5})) == 1.0


def test_no_labels_and_empty_tables(spark, no_docs):
    docs = spark.createDataFrame(corpus(20)[0], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in T.scored(docs, T.train(docs, none)).collect()} == {0.0} or max(r.score for r in T.scored(docs, T.train(docs, none)).collect()) < 1e-100
    every = spark.createDataFrame([(i, 1, 1, "") for i in range(20)], LABELS)
    assert min(r.score for r in T.scored(docs, T.train(docs, every)).collect()) > 0.999
    assert T.scored(no_docs, T.train(no_docs, none)).count() == 0
    assert T.passages(no_docs, T.Model()).count() == 0
    assert T.op12_toxicity.__name__ in T.QUERIES
