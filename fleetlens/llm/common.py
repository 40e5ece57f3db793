"""Helpers that several operators of this folder share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def is_remainder(id_col: str, modulus: int, value: int) -> Column:
    """True where :func:`id_remainder` equals ``value``; a null id gives False."""
    return F.coalesce(id_remainder(id_col, modulus) == value, F.lit(False))


def bounded_sample(df: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most ``bound`` rows of ``df``, the same ones on every run.

    Rows are taken in the order of a hash of the id, so the choice does not
    follow the order of the ids or of the files.  ``df`` should hold ids and
    labels only; join the result to the texts afterwards.
    """
    if "_order" in df.columns:
        raise ValueError("column name _order is reserved")
    ordered = df.withColumn("_order", F.xxhash64(F.col(id_col).cast("string"), F.lit(11)))
    return ordered.orderBy("_order", id_col).limit(bound).drop("_order")


def slices(batches: Iterator[pa.RecordBatch], text_at: int, max_bytes: int = 1_000_000, max_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece hold about ``max_bytes``
    and are at most ``max_rows``.

    One text is never cut; memory per piece is bounded by ``max_bytes`` plus
    the longest text.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        pa.default_memory_pool().release_unused()  # what the batch before has left
        lengths = pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths) // max_bytes
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        starts = np.concatenate([np.arange(a, b, max_rows) for a, b in zip(starts, [*starts[1:], n], strict=True)])
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


#: Rows of a written table of ids (and a few numbers each), elements of their arrays included, that may be broadcast: some tens of MB.
BROADCAST_ROWS = 500_000


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS, array: str | None = None) -> DataFrame:
    """Join ``left`` with the written table ``right``: broadcast only if its
    rows, counted first, are at most ``limit``; a shuffled join beyond that.
    If ``right`` has an array column, every element of ``array`` counts as a row too."""
    n = right.count() if array is None else right.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size(array)), F.lit(0))).first()[0]
    return left.join(F.broadcast(right) if n <= limit else right, on, how)
