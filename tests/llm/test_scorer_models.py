"""The models' arithmetic against brute force: trees, machine, profiles."""

import math
import random

import numpy as np

from fleetlens.llm import language_hd as H
from fleetlens.llm import quality_gbt as Q
from fleetlens.llm import toxicity_fm as X
from fleetlens.llm.common import slices


def labelled(n=600, width=5, seed=3):
    rng = np.random.default_rng(seed)
    rows = np.round(rng.random((n, width)), 2)
    label = (rows[:, 0] + 0.5 * (rows[:, 1] > 0.4) * rows[:, 2] + rng.normal(0, 0.1, n) > 0.7).astype(float)
    return rows, label


def walk(model, node, row):
    if model.left[node] == node:
        return model.value[node]
    side = model.left if row[model.feature[node]] <= model.threshold[node] else model.right
    return walk(model, side[node], row)


def test_flattened_walk_equals_a_recursive_walk():
    rows, label = labelled()
    model = Q.grow(rows, label, trees=25)
    fresh = np.random.default_rng(4).random((300, rows.shape[1]))
    for row, p in zip(fresh, model.probability(fresh), strict=True):
        raw = model.start + sum(walk(model, root, row) for root in model.roots)
        assert math.isclose(p, 1 / (1 + math.exp(-raw)), rel_tol=1e-12)


def test_every_split_is_the_best_of_all():
    rows, label = labelled()
    bins, l2, least, rate, depth = 16, 2.0, 8, 0.2, 3
    model = Q.grow(rows, label, trees=6, depth=depth, rate=rate, bins=bins, l2=l2, least=least)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
    score = np.full(len(rows), model.start)
    checked = 0

    def gains(at, grad, hess):
        """Gain of every admissible cut, each from its own sums."""
        out = {}
        for f, values in enumerate(cuts):
            for cut in values:
                left = at[rows[at, f] <= cut]
                right = at[rows[at, f] > cut]
                if len(left) >= least and len(right) >= least:
                    one = [grad[p].sum() ** 2 / (hess[p].sum() + l2) for p in (left, right, at)]
                    out[f, cut] = one[0] + one[1] - one[2]
        return out

    def check(node, at, level, grad, hess):
        nonlocal checked
        assert math.isclose(model.value[node], rate * grad[at].sum() / (hess[at].sum() + l2), rel_tol=1e-9, abs_tol=1e-12)
        possible = gains(at, grad, hess) if level and len(at) >= 2 * least else {}
        best = max(possible.values(), default=0.0)
        if model.left[node] == node:
            assert best <= 1e-6 + 1e-9
            score[at] += model.value[node]
            return
        checked += 1
        mine = possible[int(model.feature[node]), model.threshold[node]]
        assert math.isclose(mine, best, rel_tol=1e-9)
        low = rows[at, model.feature[node]] <= model.threshold[node]
        check(model.left[node], at[low], level - 1, grad, hess)
        check(model.right[node], at[~low], level - 1, grad, hess)

    for root in model.roots:
        p = 1 / (1 + np.exp(-score))
        check(root, np.arange(len(rows)), depth, label - p, p * (1 - p))
    assert checked > 20


def machine(width=6, factors=3, seed=5):
    rng = np.random.default_rng(seed)
    return X.Machine(np.arange(width), 0.3, rng.normal(0, 1, width), rng.normal(0, 1, (width, factors)))


def test_pair_sum_equals_the_double_loop():
    model, rng = machine(), np.random.default_rng(6)
    x = np.log1p(rng.integers(0, 4, (40, 6)))
    for row, raw in zip(x, model.raw(x), strict=True):
        want = model.bias + sum(w * a for w, a in zip(model.weight, row, strict=True))
        for i in range(6):
            for j in range(i + 1, 6):
                want += row[i] * row[j] * sum(model.factor[i] * model.factor[j])
        assert math.isclose(raw, want, rel_tol=1e-9, abs_tol=1e-9)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(7)
    x, label, l2 = np.log1p(rng.integers(0, 4, (30, 6))), rng.integers(0, 2, 30).astype(float), 0.01
    model = machine()

    def loss(bias, weight, factor):
        p = X.Machine(model.kept, bias, weight, factor).probability(x)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)) + l2 / 2 * ((weight**2).sum() + (factor**2).sum())

    now = [np.array(model.bias), model.weight, model.factor]
    for k, got in enumerate(X.gradients(model, x, label, l2)):
        for at in np.ndindex(np.shape(now[k])):
            ends = []
            for step in (1e-6, -1e-6):
                moved = [v.copy() for v in now]
                moved[k][at] += step
                ends.append(loss(float(moved[0]), moved[1], moved[2]))
            assert abs((ends[0] - ends[1]) / 2e-6 - np.asarray(got)[at]) < 1e-6


def test_counts_are_not_clipped():
    few, many = X.dense([(np.array([0]), np.array([20])), (np.array([0]), np.array([20_000]))], 1)
    assert few[0] == math.log(21) and many[0] == math.log(20_001)


def test_prediction_equals_plain_python(spark):
    rnd = random.Random(8)
    words = {"aa": ["alto", "bravo", "canto"], "bb": ["wehr", "zwolf", "kirsch"], "cc": ["été", "çà", "noël"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "!", " 12"]), lang) for i in range(60) for lang in [rnd.choice(list(words))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = H.fit(docs)
    dim, encoder = model.prototypes.shape[1], H.Encoder()

    def bundle(text):
        """Trigrams of letters, one edge between words, as the sum of bound vectors."""
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        points = [0, *(p for r in runs for p in [*map(ord, r), 0])]
        out = [0.0] * dim
        for a, b, c in zip(points, points[1:], points[2:], strict=False):
            if b:
                x, y, z = (encoder.letter(p) for p in (a, b, c))
                out = [o + x[(d - 2) % dim] * y[(d - 1) % dim] * z[d] for d, o in enumerate(out)]
        return out

    def unit(v):
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v] if size else v

    got = {r.doc_id: (r.lang_pred, r.score) for r in H.predict(docs, model).collect()}
    for i, text, _ in rows[:12]:
        v = unit(bundle(text))
        cosine = [sum(a * float(b) for a, b in zip(v, p, strict=True)) for p in model.prototypes]
        assert got[i][0] == model.names[cosine.index(max(cosine))] and abs(got[i][1] - max(cosine)) < 1e-4


def test_pieces_are_bounded_by_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 100] * 50_000})
    sizes = [p.num_rows for p in slices(iter([batch]), 0, 1_500_000, H.ROWS)]
    assert sum(sizes) == 50_000 and max(sizes) <= H.ROWS
