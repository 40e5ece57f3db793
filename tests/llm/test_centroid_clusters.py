"""Clusters by the vantage-point tree against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from fleetlens.llm import centroid_clusters as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, id string, distance int"


def brute(rows, k, rounds, dim, scale):
    """Plain Python: every vector against every centroid."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 2**52 else scale * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds if centroids else 0):
        number = [n for _, n in assign()]
        for n in set(number):
            mine = [v for (_, v), m in zip(kept, number, strict=True) if m == n]
            centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign() if centroids else []
    return sorted(((i, n, d if d < 2**63 else None) for (i, _), (d, n) in zip(kept, found, strict=False)), key=repr), centroids


def run(spark, rows, k=16, rounds=3, dim=3, scale=64):
    df = spark.createDataFrame([(i, v, "", "", 0) for i, v in rows], SCHEMA)
    assigned, centroids = C.cluster(df, k, rounds, dim, scale)
    return sorted((tuple(r) for r in assigned.collect()), key=repr), centroids


def vectors(rnd, n, dim, spread=0.4):
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    return [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(centres)]) for i in range(n)]


def test_equals_brute_force_with_ties_and_copies(spark):
    rnd = random.Random(1)
    rows = vectors(rnd, 600, 3) + [(1000 + i, [0.25, -0.5, 0.0]) for i in range(300)]
    rows += [(2000 + i, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(200)]  # many equal distances
    assert run(spark, rows) == brute(rows, 16, 3, 3, 64)


def test_edges(spark):
    rows = [(1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.1, 0.2, 0.3]), (7, []), (None, [3.0, 4.0]), (1, [0.25, 1.0]), (8, [-0.01, -0.01])]
    assert run(spark, rows, k=4, dim=2) == brute(rows, 4, 3, 2, 64)
    assert run(spark, [], dim=2) == ([], [])
    assert run(spark, [(None, [1.0, 1.0])], dim=2) == ([], [])


def test_large_components_are_exact(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([1.0, 2.0**40, -(2.0**70), 3e38]) * rnd.random() for _ in range(2)]) for i in range(60)]
    got, centroids = run(spark, rows, k=5, dim=2)
    want, expected = brute(rows, 5, 3, 2, 64)
    assert centroids == expected
    assert [(i, n) for i, n, _ in got] == [(i, n) for i, n, _ in want]
    assert [d for *_, d in got] == [d for *_, d in want] and None in [d for *_, d in got]


def test_inertia_and_digest(spark):
    rows = vectors(random.Random(3), 200, 3)
    df = spark.createDataFrame([(i, v, "", "", 0) for i, v in rows], SCHEMA)
    assigned, centroids = C.cluster(df, 6, 2, 3, 64)
    out = C.with_inertia(assigned, centroids).collect()
    total = sum(r["distance"] for r in out)
    for r in out:
        assert r["inertia"] == total
        assert r["cluster_inertia"] == sum(s["distance"] for s in out if s["cluster"] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
    empty = spark.createDataFrame([], SCHEMA)
    assert C.with_inertia(*C.cluster(empty, 6, 2, 3, 64)).collect() == []


@pytest.mark.parametrize("dim,most", [(2, 0.35), (4, 0.6)])
def test_the_tree_prunes(dim, most):
    rng = np.random.default_rng(4)
    centroids = np.floor(rng.normal(0, 4000, (200, dim))).astype(np.int64)
    points = centroids[rng.integers(0, 200, 1500)] + rng.integers(-40, 41, (1500, dim))
    visits = []
    number, distance = C.nearest(points, C.vantage_tree(centroids), visits)
    every = ((points[:, None] - centroids) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert visits[0] < most * every.size


def test_parts_are_bounded():
    rng = np.random.default_rng(5)
    centroids = np.floor(rng.normal(0, 9, (120, 2))).astype(np.int64)  # some are equal
    tree = C.vantage_tree(centroids)

    def below(node):
        return tree.own[node] + [m for child, _, _ in tree.parts[node] for m in below(child)]

    assert sorted(below(0)) == list(range(120))
    for node, parts in enumerate(tree.parts):
        for child, low, high in parts:
            away = C.root(C.squared(centroids[below(child)], centroids[tree.own[node][0]]))
            assert away.min() == low and away.max() == high


def test_limbs():
    for x in (0, -1, 2**40, -(2**40), 2**200 + 5, -(3**90)):
        assert sum(v << (40 * j) for j, v in enumerate(C.limbs(x))) == x
        assert all(abs(v) <= 2**40 for v in C.limbs(x))
