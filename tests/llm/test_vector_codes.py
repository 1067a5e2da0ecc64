"""Vector codes against plain Lloyd rounds in Python integers."""

import hashlib
import random
from collections import Counter

import numpy as np

from offerlens.llm import vector_codes as V


def brute(rows, rounds=4, parts=4, entries=256):
    """Rows of (vec_id, vector, label); every step as the definition has it."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    ints = [[int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v] + [0] * (-width % parts) for _, v, _ in kept]
    w = len(ints[0]) // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for v in ints] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(x, books[p])[1] for x in cut[p]]
            for k in range(len(books[p])):
                own = [x for x, a in zip(cut[p], at) if a == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own))
    found = [[near(x, books[p]) for x in cut[p]] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    errors = [sum(found[p][i][0] for p in range(parts)) for i in range(len(kept))]
    by_label = Counter()
    for (_, _, l), e in zip(kept, errors):
        by_label[l] += e
    return Counter((kept[i][0], "".join("%02x" % found[p][i][1] for p in range(parts)), errors[i], by_label[kept[i][2]], sha) for i in range(len(kept)))


def run(spark, rows, extra=False):
    schema = "vec_id long, embedding array<float>, label int" + (", codes int, slot string" if extra else "")
    df = spark.createDataFrame([(*r, 1, "x") if extra else r for r in rows], schema).repartition(3)
    codes, books = V.coded(df)
    sha = V.digest(books)
    return Counter((r.vec_id, r.code, r.error, r.label_error, sha) for r in V.with_label_errors(codes).collect())


def make(n, width, seed=1, levels=6):
    """Coarse values, so that many distances are equal; copies, nulls, infinities, another width, null ids and labels."""
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.randint(-levels, levels) / 4 + rng.choice((0, 0, 1e-4, -1e-4)))) for _ in range(width)], rng.choice((0, 0, 0, 1, 2, None))) for i in range(n)]
    rows += [(n + i, rows[3][1], 0) for i in range(40)] + [(5, rows[9][1], 1), (None, rows[7][1], None), (n + 90, None, 1)]
    rows += [(n + 91, [float("nan")] * width, 1), (n + 92, [float("inf")] + [0.0] * (width - 1), 1), (n + 93, [None] + [0.0] * (width - 1), 1), (n + 94, [0.5] * (width + 4), 1), (-1, None, None)]
    rng.shuffle(rows)
    return rows


def test_codes_equal_plain_lloyd(spark):
    rows = make(600, 8)
    assert run(spark, rows, extra=True) == brute(rows)


def test_few_rows_odd_widths_and_large_values(spark):
    for rows in (make(20, 4, 2), make(60, 7, 3), [(1, [1e5, -1e5, 3e4, 2.0], 1), (2, [-1e5, 1e5, 0.0, 2.5], 1), (3, [99999.0, 1e5, 1.0, 2.0], None)], [(1, [], 3), (2, [], 3)]):
        assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter()
    assert run(spark, [(1, None, 2)]) == Counter()
    assert run(spark, [(1, [1e30, 0.0, 0.0, 0.0], 2), (2, [-3e38, 0.0, 0.0, 0.0], 2)])  # out of range: held at its end


def test_bounds_skip_groups_and_change_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (40, 16))
    x = centres[rng.integers(0, 40, 5000)] + rng.integers(-200, 200, (5000, 16))
    book = V.Codebook.begun(x[:256].copy())
    at, exact, upper, lower = V.first_codes(x, book)
    pairs = 0
    for _ in range(6):
        d = V.distances(x, book.entries)
        assert (at == d.argmin(1)).all() and (exact == d.min(1)).all()
        sums = np.zeros_like(book.entries)
        np.add.at(sums, at, x)
        book = book.moved(sums, np.bincount(at, minlength=256))
        scanned = []
        at, exact, upper, lower = V.assigned(x, book, at, upper, lower, scanned)
        pairs += sum(scanned)
    assert pairs < 0.5 * 6 * len(x) * len(book.groups)


def test_wide_integers_are_exact():
    x, e = np.array([[2**27, -(2**27), 1]]), np.array([[-(2**27), 2**27, 0], [2**27 - 1, -(2**27), 1]])
    assert V.distances(x, e).tolist() == [[2 * (2**28) ** 2 + 1, 1]]


def test_decoded_vectors_are_near(spark):
    rows = make(300, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    codes, books = V.coded(df)
    near = {r.vec_id: r for r in V.decoded(codes, books).collect()}
    one = next(r for r in rows if r[0] == 17)
    got = near[17]
    assert sum((a - b) ** 2 for a, b in zip(one[1], got.vector)) * 1024**2 <= got.error * 1.1 + 1024
