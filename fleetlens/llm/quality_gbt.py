"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (shares of character classes, word and line repetition,
word lengths) are computed in the tasks.  Trees are grown on a bounded sample
of labelled rows: each statistic is cut into at most 64 bins, a node's split
comes from the bins' sums of gradients, and the finished trees are flattened
into arrays (feature, threshold, children, value).  Scoring walks all rows of
a batch through a tree at once with numpy, one step per level.

Only the labelled sample (``train_rows`` rows of some 30 numbers) reaches the
driver; scoring is one pass without a shuffle.

Defined results: null and empty texts have all statistics 0 and get a score
like any other text.  Without labelled rows, or with one class only, the score
is the share of label 1 (0.5 without rows).  Null ids and null labels are not
learned from.  Repeated rows give repeated results.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bounded_sample, slices, texts_of

#: Statistics, in the order of the columns of :func:`statistics`.
STATISTICS = (
    "bytes words lines word_length longest_word distinct_words repeated_neighbours one_letter_words symbol_words "
    "upper lower digits blanks line_feeds other_bytes full_stops commas exclamations bars symbols "
    "distinct_lines longest_line last_char_symbol upper_words two_back_equal distinct_bytes top_byte"
).split()

_BYTES = np.arange(256)
_CLASS = np.zeros((256, 11), np.float32)
for _i, _members in enumerate(
    [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", None, b".", b",", b"!?", b"|", b"#$%&*+/<=>@[\\]^_`{}~"]
):
    _CLASS[:, _i] = _BYTES >= 128 if _members is None else np.isin(_BYTES, list(_members))


def statistics(texts: list[str]) -> np.ndarray:
    """One row of :data:`STATISTICS` per text."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float64)
    counts = np.zeros((len(texts), 256), np.float32)
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        if not n:
            continue
        counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        distinct = set(words)
        row = out[i]
        row[0], row[1], row[2] = len(raw), n, len(lines)
        row[3] = sum(map(len, words)) / n
        row[4] = max(map(len, distinct))
        row[5] = len(distinct) / n
        row[6] = sum(map(operator.eq, words, words[1:])) / n
        row[7] = sum(1 for w in distinct if len(w) == 1) / n
        tails = [w for w in distinct if w[-1] in b"#$%&*|!"]
        row[8] = len(tails) / len(distinct)
        row[20] = len(set(lines)) / len(lines)
        row[21] = max(map(len, lines)) / len(raw)
        row[22] = words[-1][-1] in b"#$%&*|!"
        row[23] = sum(1 for w in distinct if w.isupper()) / len(distinct)
        row[24] = sum(map(operator.eq, words, words[2:])) / n
    total = counts.sum(axis=1, keepdims=True)
    shares = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    out[:, 9:20] = shares @ _CLASS
    out[:, 25] = (counts > 0).sum(axis=1)
    out[:, 26] = shares.max(axis=1, initial=0)
    return out


@dataclass(frozen=True)
class Trees:
    """Flattened trees: node arrays of all trees, the root of each, the start."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """Vectorised walk: every row of every tree takes one step per level."""
        total = np.full(len(rows), self.start)
        index = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):  # a leaf's children are itself
                go_left = rows[index, self.feature[node]] <= self.threshold[node]
                node = np.where(go_left, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def grow(rows: np.ndarray, label: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 2.0, least: int = 8) -> Trees:
    """Boost ``trees`` trees for the logistic loss on histograms of the rows."""
    n, width = rows.shape
    mean = float(np.mean(label)) if n else 0.5
    start = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    if n and 0 < mean < 1:
        cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)], axis=1)
        key = binned + bins * np.arange(width)
        score = np.full(n, start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = label - p, p * (1 - p)
            roots.append(_grow_node(np.arange(n), key, binned, grad, hess, cuts, nodes, depth, bins, rate, l2, least, score))
    arrays = {k: np.array(v, np.float64 if k in ("threshold", "value") else np.int64) for k, v in nodes.items()}
    return Trees(roots=np.array(roots, np.int64), depth=depth, start=start, **arrays)


def _grow_node(at, key, binned, grad, hess, cuts, nodes, depth, bins, rate, l2, least, score) -> int:
    me = len(nodes["value"])
    g, h = grad[at].sum(), hess[at].sum()
    for k, v in (("feature", 0), ("threshold", np.inf), ("left", me), ("right", me), ("value", rate * g / (h + l2))):
        nodes[k].append(v)
    best = None
    if depth and len(at) >= 2 * least:
        width = binned.shape[1]
        flat = key[at].ravel()
        hist = [np.bincount(flat, np.repeat(x, width), minlength=width * bins).reshape(width, bins).cumsum(axis=1) for x in (grad[at], hess[at], np.ones(len(at)))]
        gl, hl, nl = hist
        gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
        gain[(nl < least) | (len(at) - nl < least)] = -np.inf
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[f, b] > 1e-6 and b < len(cuts[f]):
            best = f, b
    if best is None:
        score[at] += nodes["value"][me]
        return me
    f, b = best
    goes_left = binned[at, f] <= b
    nodes["feature"][me], nodes["threshold"][me] = f, cuts[f][b]
    args = (key, binned, grad, hess, cuts, nodes, depth - 1, bins, rate, l2, least, score)
    nodes["left"][me] = _grow_node(at[goes_left], *args)
    nodes["right"][me] = _grow_node(at[~goes_left], *args)
    return me


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 12_000
) -> Trees:
    """Trees from at most ``train_rows`` labelled rows; ``labels`` holds the ids
    to learn from.  Rows are taken in the order of a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")
    )
    chosen = bounded_sample(known, "_id", train_rows)
    # proven size: train_rows pairs of id and label
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # an id that repeats is learned from once, by its smallest text
    train = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct("_text", "_label")).alias("r")).select("_id", "r.*").select("_label", "_text")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            stats = statistics(texts_of(piece.column(1)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(list(stats), pa.list_(pa.float64()))], names=["label", "stats"])

    table = train.mapInArrow(rows_of, "label double, stats array<double>").toPandas()
    if not len(table):
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    rows, label = np.stack(table["stats"].to_numpy()), table["label"].to_numpy()
    order = np.lexsort((*rows.T, label))  # the same trees whatever order the rows arrive in
    return grow(rows[order], label[order])


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``score``, the probability of label 1."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            p = model.probability(statistics(texts_of(piece.column(1))))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(p)], names=["id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, score double")


def keep(docs: DataFrame, model: Trees, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, at):
            good = model.probability(statistics(texts_of(piece.column(at)))) >= threshold
            if good.any():
                yield piece.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
