"""Quality, toxicity and language models: held-out accuracy and edges."""

import math

import numpy as np
import pytest

from fleetlens.llm import language_hd as H
from fleetlens.llm import quality_gbt as Q
from fleetlens.llm import toxicity_fm as X
from fleetlens.llm.common import bounded_sample, is_remainder
from fleetlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, _label int, _id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.0, 1, "") for i, t, lang in rows], SCHEMA)


@pytest.mark.parametrize(("name", "column", "least"), [("op3_quality_gbt", "quality", 0.95), ("op8_toxicity_fm", "toxic", 0.9)])
def test_held_out_labels(spark, name, column, least):
    rows = QUERIES[name](spark, SF)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows.where("score is null or score < 0 or score > 1").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", column)
    seen = rows.where("held_out").join(labels, "doc_id").collect()
    assert len(seen) > 50 and np.mean([r.predicted == r[column] for r in seen]) >= least


def test_held_out_languages(spark):
    rows = QUERIES["op9_language_hd"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    seen = rows.where("held_out").join(docs, "doc_id").collect()
    assert len(seen) > 200 and np.mean([r.lang_pred == r.lang for r in seen]) >= 0.97
    assert all(0 <= r.score <= 1 for r in seen)


def test_labels_of_the_fold_do_not_matter(spark):
    """Changing held-out labels changes no score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", (1 - labels.quality)).where(is_remainder("doc_id", 5, 0)).unionByName(labels.where(~is_remainder("doc_id", 5, 0)))
    a, b = (Q.fit(docs, x.where(~is_remainder("doc_id", 5, 0))) for x in (labels, other))
    assert a.value.tolist() == b.value.tolist()


EDGES = [(1, None, None), (2, "", "en"), (3, " \n ", "en"), (4, "12 34 !!", "en"), (5, "the of and " * 20_000, "en"), (5, "the of and", "en"), (None, "le la les", None), (6, "🎉é漢字 かな", "fr")]


def test_scorer_edges(spark):
    docs = frame(spark, EDGES)
    labels = spark.createDataFrame([(1, 0, 1, "x"), (2, 1, 0, "x"), (5, 1, 0, "x"), (None, 1, 1, "x"), (3, None, None, "x"), (9, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    for rows in (Q.score(docs, Q.fit(docs, labels)), X.score(docs, X.fit(docs, labels))):
        got = rows.collect()
        assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    found = {(r.doc_id, r.lang_pred) for r in H.predict(docs, H.fit(docs)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "en")} <= found


def test_no_labels_and_empty_tables(spark):
    docs, none = frame(spark, EDGES), frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.score(docs, Q.fit(docs, labels)).collect()} == {0.5}
    assert all(r.score < 1e-9 for r in X.score(docs, X.fit(docs, labels)).collect())
    assert {(r.lang_pred, r.score) for r in H.predict(docs, H.fit(none)).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(2, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.99 for r in Q.score(docs, Q.fit(docs, one)).collect())
    assert all(r.score > 0.99 for r in X.score(docs, X.fit(docs, one)).collect())
    assert Q.score(none, Q.fit(docs, labels)).count() == X.score(none, X.fit(none, labels)).count() == H.predict(none, H.fit(docs)).count() == 0


def test_keep_filters_rows_with_all_columns(spark):
    docs = frame(spark, EDGES)
    rows = np.zeros((40, len(Q.STATISTICS)))
    rows[20:, 1] = 3
    model = Q.grow(rows, np.repeat([0.0, 1.0], 20))  # texts with words are good
    kept = Q.keep(docs, model, 0.3)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 5, 6]


def test_trees_fit_a_step_and_an_interaction():
    rng = np.random.default_rng(0)
    rows = rng.random((2000, 3))
    label = ((rows[:, 0] > 0.5) != (rows[:, 1] > 0.3)).astype(float)
    p = Q.grow(rows, label).probability(rows)
    assert np.mean((p > 0.5) == label) > 0.98
    model = Q.grow(rows, label)
    leaf = model.left == np.arange(len(model.left))
    assert (model.right[leaf] == np.flatnonzero(leaf)).all() and len(model.roots) == 60


def test_machine_learns_a_pair_of_terms():
    """Two terms that mean nothing alone and toxic together."""
    rng = np.random.default_rng(1)
    rows, label = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        at = np.array(sorted({int(x) for x in rng.integers(100, 140, 5)} | ({7} if a else set()) | ({9} if b else set())))
        rows.append((at, np.ones(len(at), np.int64)))
        label.append(float(a and b))
    model = X.learn(rows, np.array(label))
    x = np.zeros((4, len(model.kept)))
    i, j = (int(np.flatnonzero(model.kept == t)[0]) for t in (7, 9))
    x[1, i] = x[2, j] = x[3, i] = x[3, j] = 1
    p = model.probability(x)
    assert p[3] > 0.7 and p[:3].max() < 0.3
    pairs = sum(model.factor[i] * model.factor[j])
    assert pairs > 0.5


def test_bundle_equals_the_definition():
    e = H.Encoder(64)
    got = e.bundles(["Ab  c!", "", "9"])
    letter = {c: e.letter(ord(c)) for c in "abc"}
    edge = e.letter(0)

    def bind(x, y, z):
        return np.roll(x, 2) * np.roll(y, 1) * z

    want = bind(edge, letter["a"], letter["b"]) + bind(letter["a"], letter["b"], edge) + bind(edge, letter["c"], edge)
    assert np.allclose(got[0], want) and not got[1:].any()


def test_sample_bound(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id for r in bounded_sample(df.repartition(n), "doc_id", 40).collect()} for n in (3, 7))
    assert a == b and len(a) == 40 and math.isclose(np.mean(list(a)), 250, abs_tol=90)
