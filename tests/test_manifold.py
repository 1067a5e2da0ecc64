"""t-SNE: its parts against direct computation, its result against PCA's."""

import numpy as np
import pytest

from offerlens.operators import manifold

SCHEMA = "id long, embedding array<float>, position int"


def points(n=240, groups=8, width=24, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 4
    own = rng.integers(0, groups, n)
    return (centres[own] + rng.normal(size=(n, width))).astype(np.float32), own


def trustworthiness(x, y, k=7):
    """1 less the ranks in x of points that are neighbours in y only."""
    n = len(x)
    rank = lambda a: np.argsort(np.argsort(((a[:, None] - a[None]) ** 2).sum(2) + np.diag([-1.0] * n), axis=1), axis=1)
    rx, ry = rank(x.astype(float)), rank(y)
    lost = np.where((ry >= 1) & (ry <= k) & (rx > k), rx - k, 0).sum()
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


def test_perplexity_is_met():
    rng = np.random.default_rng(1)
    p = manifold.bisected(rng.uniform(0.1, 900, (50, 90)), 30.0)
    assert np.allclose(np.exp(-(p * np.log(p)).sum(1)), 30, rtol=1e-6) and np.allclose(p.sum(1), 1)
    assert np.isfinite(manifold.bisected(np.zeros((2, 5)), 3.0)).all()


def test_octree_equals_all_pairs_where_no_cell_is_far():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(300, 3))
    y[7] = y[9]
    gap = y[:, None] - y[None]
    q = 1 / (1 + (gap**2).sum(2))
    z, force = manifold.Octree(y).repulsion(y, angle=0.0)
    assert np.allclose(z, q.sum(1)) and np.allclose(force, (q[:, :, None] ** 2 * gap).sum(1))
    z, force = manifold.Octree(y).repulsion(y, angle=0.5)
    assert np.allclose(z, q.sum(1), rtol=0.02) and np.abs(force - (q[:, :, None] ** 2 * gap).sum(1)).max() < 0.05 * np.abs(force).max()


@pytest.fixture(scope="module")
def shown(spark, tmp_path_factory):
    x, own = points()
    rows = [(int(i), [float(v) for v in x[i]], 1) for i in np.random.default_rng(0).permutation(len(x))]
    rows += [(1000, rows[0][1], 1), (1001, None, 1), (None, rows[1][1], 1), (1002, [float("inf")] * 24, 1), (1003, [0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = tmp_path_factory.mktemp("tsne")
    how = {"perplexity": 15.0, "steps": 120}
    one = {r.id: r.position for r in manifold.tsne(df, f"file://{path}/a", **how).collect()}
    two = {r.id: r.position for r in manifold.tsne(df.repartition(5), f"file://{path}/b", **how).collect()}
    return x, own, rows, one, two


def test_reruns_are_equal_and_copies_share_a_place(shown):
    x, _, rows, one, two = shown
    assert one == two and set(one) == set(range(len(x))) | {1000}
    assert one[1000] == one[rows[0][0]]


def test_neighbours_are_kept_better_than_by_pca(spark, shown):
    x, own, _, one, _ = shown
    y = np.array([one[i] for i in range(len(x))])
    c = x - x.mean(0)
    pca = c @ np.linalg.svd(c.astype(float), full_matrices=False)[2][:3].T
    assert trustworthiness(x, y) > max(0.9, trustworthiness(x, pca))
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, embedding array<float>")
    kept = [manifold.preserved(frame(x), frame(m), 7).first().preserved for m in (y, pca)]
    assert kept[0] > kept[1]
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(2) + np.diag([np.inf] * len(y)), axis=1)[:, 0]
    assert (own[near] == own).mean() > 0.95


def test_rows_beyond_the_landmarks_are_placed_among_their_neighbours(spark, tmp_path):
    x, own = points(160, 4)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(len(x))], SCHEMA)
    got = {r.id: r.position for r in manifold.tsne(df, f"file://{tmp_path}/t", landmarks=60, steps=60, perplexity=10.0).collect()}
    y = np.array([got[i] for i in range(len(x))])
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(2) + np.diag([np.inf] * len(y)), axis=1)[:, 0]
    assert len(got) == 160 and (own[near] == own).mean() > 0.9


def test_few_and_none(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert manifold.tsne(none, f"file://{tmp_path}/n").count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)
    assert {tuple(r.position) for r in manifold.tsne(same, f"file://{tmp_path}/s").collect()} == {(0.0, 0.0, 0.0)}
    two = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 0)], SCHEMA)
    assert len({tuple(r.position) for r in manifold.tsne(two, f"file://{tmp_path}/w", steps=5).collect()}) == 2
