"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point.  An
n-gram of three letters is bound into one vector: the first letter's vector
rotated by two places times the second's rotated by one times the third's.  A
text is the bundle (sum) of its n-gram vectors, a language the bundle of its
documents' vectors, each of length one.  A document gets the language whose
prototype has the largest cosine with it.

Learning reads a bounded sample of labelled rows (``train_rows``), spread over
the tasks; each task returns one partial bundle per language and Spark adds
them.  What reaches the driver is languages x dimensions numbers.

Defined results: text null or without a letter gives ``und`` and score 0, as
does everything when no labelled row exists.  Ties take the language that
sorts first.  Scores are cosines, negative ones raised to 0.  A null id or
null language is never learned from.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bounded_sample, slices, texts_of

DIM = 1024
UNKNOWN = "und"


ROWS = 512  #: texts of a piece: a piece counts its n-grams in a table of texts by 8,192 n-grams


@dataclass(frozen=True)
class Profiles:
    """Language names in order and one prototype of length one for each."""

    names: tuple[str, ...]
    prototypes: np.ndarray


class Encoder:
    """Turns texts into bundles; keeps letter vectors it has drawn."""

    def __init__(self, dim: int = DIM, seed: int = 7) -> None:
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            bits = np.random.default_rng((self.seed, point)).integers(0, 2, self.dim)
            self.letters[point] = (2 * bits - 1).astype(np.float32)
        return self.letters[point]

    def bundles(self, texts: list[str]) -> np.ndarray:
        """One row per text; a text without letters has the zero vector."""
        out = np.zeros((len(texts), self.dim), np.float32)
        lowered = [t.lower() for t in texts]
        points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        alphabet = [int(p) for p in np.flatnonzero(seen) if chr(p).isalpha()]
        if not alphabet:
            return out
        code = np.zeros(0x110000, np.int64)
        code[alphabet] = np.arange(1, len(alphabet) + 1)  # 0: no letter
        sym = code[points]
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0)  # runs of other characters count as one
        sym, doc = sym[keep], np.concatenate([[0], doc])[: len(keep)][keep]
        k = len(alphabet) + 1
        middle = np.flatnonzero(sym[1:-1] > 0) + 1
        gram = (sym[middle - 1] * k + sym[middle]) * k + sym[middle + 1]
        doc = doc[middle]
        if k**3 <= 4_000_000:
            there = np.zeros(k**3, bool)
            there[gram] = True
            distinct = np.flatnonzero(there)
            place = np.zeros(k**3, np.int64)
            place[distinct] = np.arange(len(distinct))
            at = place[gram]
        else:
            distinct, at = np.unique(gram, return_inverse=True)
        base = np.stack([self.letter(0), *(self.letter(p) for p in alphabet)])
        turned = (np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base)
        step = 8192  # n-grams at a time, so that rare alphabets stay within memory
        for a in range(0, len(distinct), step):
            part = distinct[a : a + step]
            vectors = turned[0][part // (k * k)] * turned[1][part // k % k] * turned[2][part % k]
            mine = slice(None) if len(distinct) <= step else (at >= a) & (at < a + len(part))
            counts = np.bincount(doc[mine] * len(part) + at[mine] - a, minlength=len(texts) * len(part))
            out += counts.reshape(len(texts), len(part)).astype(np.float32) @ vectors
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 12_000) -> Profiles:
    """Prototypes from at most ``train_rows`` rows of ``docs`` with a language.

    The bound is on rows: every chosen text is used whole.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and _id is not null")
    chosen = bounded_sample(known.select("_id"), "_id", train_rows).distinct()
    # proven size: train_rows ids at most
    train = known.join(F.broadcast(chosen), "_id", "left_semi").select("lang", "text")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(), {}
        for piece in slices(batches, 1, 1_500_000, ROWS):
            rows = unit(encoder.bundles(texts_of(piece.column(1)))).astype(np.float64)
            langs = np.array(piece.column(0).to_pylist(), object)
            for name in set(langs):
                total[name] = total.get(name, 0) + rows[langs == name].sum(axis=0)
        if total:
            names = sorted(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(names), "part": pa.array([total[n].tolist() for n in names], pa.list_(pa.float64()))})

    parts = train.mapInArrow(partial, "lang string, part array<double>")
    sums = parts.select("lang", F.posexplode("part").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    table = sums.toPandas()
    wide = table.pivot(index="lang", columns="place", values="x").sort_index() if len(table) else table
    rows = unit(wide.to_numpy(np.float64)) if len(table) else np.zeros((0, DIM))
    return Profiles(tuple(wide.index) if len(table) else (), rows.astype(np.float32))


def predict(docs: DataFrame, model: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``lang_pred`` and ``score``."""
    names, prototypes = np.array([*model.names, UNKNOWN], object), model.prototypes
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(piece: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        rows = unit(encoder.bundles(texts_of(piece.column(1))))
        best, top = np.full(len(rows), -1), np.zeros(len(rows))
        if len(prototypes):
            cosine = rows.astype(np.float64) @ prototypes.T.astype(np.float64)
            known = np.abs(rows).sum(axis=1) > 0
            best = np.where(known, cosine.argmax(axis=1), -1)
            top = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0)
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(names[best], pa.string()), pa.array(top)], names=["id", "lang", "score"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for piece in slices(batches, 1, 1_500_000, ROWS):
            yield score(piece, encoder)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(pieces, f"`{id_col}` {id_type}, lang_pred string, score double")
