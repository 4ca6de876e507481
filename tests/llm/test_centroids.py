"""Centroid clustering against plain rounds in whole numbers: trees, ties, wide components, few and repeated vectors."""

import hashlib
import random

import numpy as np
import pytest

from candela.llm import centroids

EXTRA = "vec_id long, embedding array<double>, label int, cluster string, v int, id int, n string"


def plain(rows, k=16, rounds=3, dimension=64):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, sha) of Lloyd's rounds, without any tree."""
    x = [(i, [int(np.floor(64 * v)) for v in e]) for i, e in rows if i is not None and e is not None and len(e) == dimension and all(v is not None and np.isfinite(v) for v in e)]
    start = sorted(x, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in start]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for r in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in x]
        if r < rounds:
            own = [[v for (_, v), a in zip(x, at) if a == j] for j in range(len(c))]
            c = [[sum(col) // len(o) for col in zip(*o)] if o else m for o, m in zip(own, c)]
    d = [far(v, c[a]) for (_, v), a in zip(x, at)]
    total = [sum(e for e, b in zip(d, at) if b == j) for j in range(len(c))]
    return sorted((i, a, e, total[a], sum(d), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, e in zip(x, at, d))


def run(spark, rows, **kwargs):
    df = spark.createDataFrame([(i, e, 1, "x", 2, 3, "y") for i, e in rows], EXTRA).repartition(3)
    return sorted(tuple(r) for r in centroids.clustered(df, **kwargs).collect())


def test_clusters_with_ties_repeats_and_rows_that_take_no_part(spark):
    rng, rows = random.Random(1), []
    for i in range(300):
        base = i % 5
        rows.append((i, [base * 4 + rng.choice([-1, 0, 0, 1]) / 64 for _ in range(64)]))
    rows += [(i, [float(i % 3)] * 64) for i in range(300, 340)] + rows[:20]
    rows += [(400, None), (401, [1.0] * 63), (402, [1.0] * 63 + [None]), (403, [float("nan")] + [0.0] * 63), (404, [float("inf")] + [0.0] * 63), (None, [1.0] * 64), (405, [])]
    got = run(spark, rows)
    assert got == plain(rows) and len({r[1] for r in got}) > 5


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_components_beyond_exact_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-(3 << 26), 3 << 26)) / 64 for _ in range(4)]) for i in range(200)]
    far = lambda scale: [(i, [v * scale for v in e]) for i, e in rows]
    for scale in (1, 1 / (1 << 8), 0.125):
        assert run(spark, far(scale)[:60], k=5, dimension=4, block=16, bucket=2) == plain(far(scale)[:60], 5, 3, 4)
    with pytest.raises(Exception):
        run(spark, [(i, [v * 1e7 for v in e]) for i, e in rows], k=3, dimension=4)


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-900, 900, (200, 6)), np.zeros((50, 6), np.int64)])
    tree, order = centroids.cover_tree(x, 60)
    own = x[order]
    assert sorted(order.tolist()) == list(range(250)) and (tree.lo[0], tree.hi[0]) == (0, 250)
    for i in range(len(tree.lo)):
        below = range(tree.child[i], tree.child[i] + tree.children[i])
        assert np.sqrt(((own[tree.lo[i]: tree.hi[i]] - own[tree.center[i]]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-6
        if tree.children[i]:
            assert [tree.lo[j] for j in below] == [tree.lo[i], *[tree.hi[j] for j in below][:-1]] and tree.hi[below[-1]] == tree.hi[i]
            assert tree.center[below[0]] == tree.center[i] and len({tree.center[j] for j in below}) == len(below)


def test_dual_tree_prunes_clustered_vectors_and_never_errs():
    rng = np.random.default_rng(5)
    middle = rng.integers(-4000, 4000, (12, 64))
    spread = middle[rng.integers(0, 12, 2000)] + rng.integers(-40, 40, (2000, 64))
    for x, most in ((spread, 0.1), (rng.integers(-40, 40, (500, 64)), 1.0), (rng.integers(0, 3, (500, 2)), 1.0)):
        tree, order = centroids.cover_tree(x, len(x) // 8)
        x = x[order]
        c = np.concatenate([middle + 3, x[:4]]) if most < 1 else x[rng.integers(0, len(x), 16)]
        label, took = centroids.dual_tree_labels(x, tree, np.array([0]), c)
        assert (label == ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        assert took <= most * len(x) * 16
