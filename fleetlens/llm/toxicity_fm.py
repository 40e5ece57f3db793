"""Toxicity: a factorization machine over hashed terms.

Terms are a text's words (letters only, lower case) and the first five letters
of longer words, hashed into ``2**18`` buckets.  The model is

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

with x the logarithm of one plus a term's count: beside a weight for every term it learns a
small vector, and the product of two vectors weighs a pair of terms, so an
insult beside another term can count for more than both alone.  Buckets that
tell nothing about the label in the sample (chi-squared statistic) are left
out, so a long text of plain words adds no noise.

Fitting uses a bounded sample of labelled rows (``train_rows``), whose hashed
terms -- not texts -- reach the driver; scoring is one pass without a shuffle.

Defined results: null and empty texts have no terms and score as the model's
constant.  Without labelled rows the score is 0; with one class only it is
that class's share.  Null ids and null labels are not learned from.  Repeated
rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bounded_sample, slices, texts_of

BUCKETS = 1 << 18
PREFIX = 5
_NOT_LETTERS = re.compile(r"[\W\d_]+")


class Terms:
    """Hashed terms of texts; remembers the buckets of tokens it has met."""

    def __init__(self, kept: np.ndarray | None = None, max_tokens: int = 500_000) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.max_tokens = max_tokens
        self.kept = None if kept is None else {int(b): i for i, b in enumerate(kept)}

    def buckets(self, token: str) -> tuple[int, ...]:
        """Buckets of the words inside a blank-separated token."""
        out = []
        for word in _NOT_LETTERS.split(token.lower()):
            if word:
                out.append(zlib.crc32(b"w:" + word.encode("utf-8", "surrogatepass")) % BUCKETS)
                if len(word) > PREFIX:
                    out.append(zlib.crc32(b"p:" + word[:PREFIX].encode("utf-8", "surrogatepass")) % BUCKETS)
        if self.kept is not None:
            out = [self.kept[b] for b in out if b in self.kept]
        return tuple(out)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets (or places among the kept ones) and their counts."""
        known, found = self.known, []
        if len(known) > self.max_tokens:
            known.clear()
        for token in text.split():
            b = known.get(token)
            if b is None:
                b = known[token] = self.buckets(token)
            if b:
                found += b
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique(np.array(found, np.int64), return_counts=True)


@dataclass(frozen=True)
class Machine:
    """Kept buckets, weights, factors."""

    kept: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -60, 60)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        pairs = (x @ self.factor) ** 2 - (x * x) @ (self.factor**2)
        return self.bias + x @ self.weight + 0.5 * pairs.sum(axis=1)


def dense(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for i, (at, count) in enumerate(rows):
        x[i, at] = np.log1p(count)
    return x


def gradients(model: Machine, x: np.ndarray, label: np.ndarray, l2: float) -> list:
    """Gradients of the mean logistic loss plus half ``l2`` times the squared
    weights and factors: of the bias, the weights and the factors."""
    g = (model.probability(x) - label) / len(x)
    by_factor = x.T @ (g[:, None] * (x @ model.factor)) - ((x * x).T @ g)[:, None] * model.factor
    return [g.sum(), x.T @ g + l2 * model.weight, by_factor + l2 * model.factor]


def learn(
    rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, width: int = 1024, factors: int = 6, epochs: int = 30, rate: float = 0.2, l2: float = 1e-5, seed: int = 5
) -> Machine:
    """Fit by Adagrad on the logistic loss; rows are (buckets, counts)."""
    n, mean = len(rows), float(np.mean(label)) if len(rows) else 0.0
    if not n or mean in (0.0, 1.0):
        bias = 60.0 if mean == 1.0 else -60.0
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, factors)))
    with_term, with_both = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for (at, _), y in zip(rows, label, strict=True):
        with_term[at] += 1
        with_both[at] += y
    expected = with_term * mean
    chi = (with_both - expected) ** 2 / np.maximum(expected * (1 - mean) * (1 - with_term / n), 1e-9)
    chi[(with_term < 5) | (with_term == n)] = 0
    kept = np.sort(np.lexsort((np.arange(BUCKETS), -chi))[:width])
    kept = kept[chi[kept] > 8]
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    small = [(place[at][place[at] >= 0], count[place[at] >= 0]) for at, count in rows]
    rng = np.random.default_rng(seed)
    bias, weight, factor = float(np.log(mean / (1 - mean))), np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), factors))
    sums = [1e-6, np.full(len(kept), 1e-6), np.full((len(kept), factors), 1e-6)]
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, 128):
            part = order[a : a + 128]
            x = dense([small[i] for i in part], len(kept))
            grads = gradients(Machine(kept, bias, weight, factor), x, label[part], l2)
            for i, d in enumerate(grads):
                sums[i] = sums[i] + d * d
            bias -= rate * grads[0] / np.sqrt(sums[0])
            weight = weight - rate * grads[1] / np.sqrt(sums[1])
            factor = factor - 0.3 * rate * grads[2] / np.sqrt(sums[2])
    return Machine(kept, float(bias), weight, factor)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 10_000
) -> Machine:
    """A machine from at most ``train_rows`` labelled rows; ``labels`` holds the
    ids to learn from.  Rows are taken in the order of a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")
    )
    chosen = bounded_sample(known, "_id", train_rows)
    # proven size: train_rows pairs of id and label
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # an id that repeats is learned from once, by its smallest text
    train = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct("_text", "_label")).alias("r")).select("_id", "r.*").select("_id", "_label", "_text")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for piece in slices(batches, 2):
            rows = [terms.of(t) for t in texts_of(piece.column(2))]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).cast(pa.string()),
                    piece.column(1),
                    pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                    pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                ],
                names=["id", "label", "terms", "counts"],
            )

    table = train.mapInArrow(rows_of, "id string, label double, terms array<int>, counts array<int>").toArrow().sort_by("id")
    rows = []
    for batch in table.to_batches():
        for t, c in zip(batch.column(2), batch.column(3), strict=True):
            rows.append((t.values.to_numpy().astype(np.int64), c.values.to_numpy().astype(np.int64)))
    return learn(rows, table.column("label").to_numpy())


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``score``, the probability of label 1."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(model.kept)
        for piece in slices(batches, 1):
            x = dense([terms.of(t) for t in texts_of(piece.column(1))], len(model.kept))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.probability(x))], names=["id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, score double")
