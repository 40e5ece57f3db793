"""Dual-tree search against brute force."""

import math
import random

import numpy as np

from fleetlens.llm import topk_covertree as T


def brute(rows, queries, k):
    def ints(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    data = [(i, ints(v)) for i, v in rows if i is not None]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in ((i, ints(v)) for i, v in queries) if v is not None}:
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in data if v is not None and i != q and len(v) == len(qv))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, queries, k=5, **options):
    schema = "vec_id long, embedding array<float>, score int, rank string"
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], schema)
    qs = spark.createDataFrame([(i, v, 0, "") for i, v in queries], schema)
    return sorted(tuple(r) for r in T.top_k(df, qs, k, **options).collect())


def vectors(rnd, n, dim):
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        c = rnd.choice(centres)
        out.append((i, [float(np.float32(x + rnd.gauss(0, 0.2))) for x in c]))
    return out


def test_blocks_and_duplicates_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = vectors(rnd, 500, 6)
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one very common vector
    queries = [r for r in rows if r[0] % 25 == 0]
    assert run(spark, rows, queries, data_block=64, query_block=8) == brute(rows, queries, 5)


def test_edges(spark):
    rows = [(1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.1, 0.2, 0.3]), (7, [-1.0, 0.0]), (8, []), (9, []), (1, [0.5, 1.0])]
    assert run(spark, rows, rows) == brute(rows, rows, 5)
    assert run(spark, rows, []) == [] and run(spark, [], rows) == [] and run(spark, [], []) == []


def test_pruning_skips_work_and_keeps_ties():
    rng = np.random.default_rng(5)
    data = np.floor(rng.normal(0, 30, (3000, 3)) + 300 * rng.integers(-1, 2, (3000, 3)))
    queries = data[:40]
    ids = np.arange(3000)
    seen = {}
    got, found = T.search(queries, ids[:40], data, ids, 4, seen=seen)
    scores = queries @ data.T
    for i in range(40):
        order = sorted((-scores[i, j], j) for j in range(3000) if j != i)[:4]
        assert list(zip(got[i], found[i], strict=True)) == [(-s, j) for s, j in order]
    assert seen["pruned"] > 0 and seen["pairs"] < 0.25 * 40 * 3000


def test_known_scores_prune_more():
    rng = np.random.default_rng(6)
    data = np.floor(rng.normal(0, 100, (2000, 8)))
    queries = data[:10]
    ids = np.arange(2000)
    free, told = {}, {}
    got, found = T.search(queries, ids[:10], data, ids, 3, seen=free)
    again, same = T.search(queries, ids[:10], data, ids, 3, least=np.array([r[-1] for r in got], float), seen=told)
    assert (again, same) == (got, found) and told["pairs"] < free["pairs"]


def test_cover_tree_covers():
    rng = np.random.default_rng(6)
    for points in (np.round(rng.normal(0, 9, (700, 4))), np.round(rng.normal(0, 90, (500, 32))), np.zeros((50, 3))):
        stack, seen = [T.cover_tree(points)], []
        while stack:
            node = stack.pop()
            assert np.linalg.norm(points[node.index] - node.centre, axis=1).max() <= node.radius + 1e-9
            assert sorted(np.concatenate([*(c.index for c in node.children), node.single])) == sorted(node.index)
            assert all(c.radius <= node.radius / 2 + 1e-9 for c in node.children)
            seen += node.single.tolist()
            stack += node.children
        assert sorted(seen) == list(range(len(points)))


def test_cells_are_pruned_before_the_shuffle(spark):
    rnd = random.Random(9)
    rows = vectors(rnd, 1500, 6)
    queries = [r for r in rows if r[0] % 50 == 0]
    shares = {}
    assert run(spark, rows, queries, data_block=64, query_block=8, cells=24, shares=shares) == brute(rows, queries, 5)
    assert shares["sent"] < 0.5 * shares["all"]


def test_large_components_are_exact(spark):
    rnd = random.Random(10)
    rows = [(i, [rnd.choice([1e6, 2e6, -3.5e7, 2.0**45]) * rnd.random() for _ in range(4)]) for i in range(80)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = run(spark, rows, rows[:9], data_block=16)
    want = brute(rows, rows[:9], 5)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == [r[3] if abs(r[3]) < 2**63 else None for r in want]
