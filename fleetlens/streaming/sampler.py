"""Structured Streaming form of the time-bucket sampler (extension of A1-A6).

Metrics arrive continuously; the stream keeps one row per (group, bucket):

1. ``withWatermark`` + tumbling ``window`` + ``max_by``/``max`` in append
   mode: a bucket is emitted once the watermark passes its end.  Rows later
   than the watermark are dropped by Spark (the batch sampler has no such
   rule; there is nothing in the reference to match).
2. ``applyInPandasWithState`` keyed by group carries the last non-null value
   of every counter, and the last pair of every quotient's inputs, across
   micro-batches and turns them into reset-aware rates, latencies and ratios.
   The state per group is one number per counter and two per quotient.  It
   expires: a group without a bucket for ``ttl`` of event time is dropped, and
   starts anew if it ever returns.

Spark does not allow a pandas state function after a streaming aggregation
in append mode, so the two stages are two streaming queries chained through
a Parquet folder (``start_sampler``): stage 1 appends finished buckets, stage
2 reads them as a stream.  Both keep their progress in checkpoint folders
under the shared ``spark.checkpoint.dir`` and resume after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.functions.timeutil import parse_interval_ms


def stream_buckets(
    events: DataFrame,
    group_cols: list[str],
    interval: str,
    watermark: str,
    ts_col: str = "timestamp",
    id_col: str = "_id",
    max_fields: tuple[str, ...] = (),
) -> DataFrame:
    """Newest row and bucket maxima per (group, window) on a stream."""
    interval_ms = parse_interval_ms(interval)
    cols = [c for c in events.columns]
    aggs = [F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.struct(F.col(ts_col), F.col(id_col))).alias("__snap")]
    aggs += [F.max(F.col(f).cast("double")).alias(f"__max_{f}") for f in max_fields]
    grouped = (
        events.withWatermark(ts_col, watermark)
        .groupBy(*[F.col(g) for g in group_cols], F.window(F.col(ts_col), f"{interval_ms} milliseconds"))
        .agg(*aggs)
    )
    out = grouped.select(
        "__snap.*",
        (F.unix_micros(F.col("window.start")) / 1000).cast("bigint").alias("bucket_ms"),
        *[F.col(f"__max_{f}") for f in max_fields],
    )
    for f in max_fields:
        out = out.withColumn(f, F.coalesce(F.col(f"__max_{f}"), F.col(f).cast("double"))).drop(f"__max_{f}")
    return out


def _grown(now: pd.Series, before: pd.Series) -> pd.Series:
    """What a counter grew by; its own value after a reset; missing without a
    value before."""
    return (now - before).where(now >= before, now).where(before.notna())


def stream_rates(
    sampled: DataFrame,
    group_cols: list[str],
    counters: tuple[str, ...],
    interval: str,
    bucket_col: str = "bucket_ms",
    quotients: dict[str, tuple[str, str]] | None = None,
    ttl: str = "30d",
) -> DataFrame:
    """Reset-aware counter rates and quotients of deltas across micro-batches
    (A3, A4, A5, A8 on a stream).

    Output: the group columns, the bucket, one ``double`` rate per counter and
    one per quotient (output name -> (numerator, denominator)), as the batch
    sampler gives them.  The state of a group without a bucket for ``ttl`` is
    removed when the stream's newest bucket is that much later.
    """
    seconds = parse_interval_ms(interval) / 1000.0
    quotients = quotients or {}
    inputs = list(dict.fromkeys([*counters, *(p for pair in quotients.values() for p in pair)]))
    key_fields = [sampled.schema[g] for g in group_cols]
    out_schema = T.StructType(
        key_fields + [T.StructField(bucket_col, T.LongType())] + [T.StructField(c, T.DoubleType()) for c in (*counters, *quotients)]
    )
    state_schema = T.StructType(
        [T.StructField(f"last_{c}", T.DoubleType()) for c in counters]
        + [T.StructField(f"{part}_{q}", T.DoubleType()) for q in quotients for part in ("above", "below")]
    )

    def carried(values: pd.Series, last: float | None) -> pd.Series:
        before = values.ffill().shift(1)
        return before if last is None else before.fillna(last)

    def newest(values: pd.Series, last: float | None) -> float | None:
        return float(values.dropna().iloc[-1]) if values.notna().any() else last

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get) if state.exists else [None] * len(state_schema)
        frames = [b for b in batches]
        if not frames:
            return
        # one row per bucket of the series in this micro-batch, in order
        pdf = pd.concat(frames).sort_values(bucket_col)
        out = pd.DataFrame({f.name: k for f, k in zip(key_fields, key, strict=True)}, index=pdf.index)
        out[bucket_col] = pdf[bucket_col].astype("int64")
        numbers = {c: pd.to_numeric(pdf[c]).astype("float64") for c in inputs}
        for i, c in enumerate(counters):
            before = carried(numbers[c], last[i])
            out[c] = (_grown(numbers[c], before) / seconds).where(before.notna(), numbers[c])
            last[i] = newest(numbers[c], last[i])
        for i, (q, (a, b)) in enumerate(quotients.items()):
            at = len(counters) + 2 * i
            both = numbers[a].notna() & numbers[b].notna()
            above, below = numbers[a].where(both), numbers[b].where(both)
            grown = [_grown(x, carried(x, last[at + j])) for j, x in enumerate((above, below))]
            out[q] = (grown[0] / grown[1]).where(grown[1] != 0, 0.0).where(both & grown[0].notna() & grown[1].notna())
            last[at], last[at + 1] = newest(above, last[at]), newest(below, last[at + 1])
        state.update(tuple(last))
        # the watermark lags the newest bucket by ``ttl``, so this passes when the group is that old
        state.setTimeoutTimestamp(max(int(pdf[bucket_col].iloc[-1]), state.getCurrentWatermarkMs()) + 1)
        yield out[[f.name for f in out_schema.fields]]

    return (
        sampled.select(*group_cols, bucket_col, *inputs, F.timestamp_millis(bucket_col).alias("__at"))
        .withWatermark("__at", f"{parse_interval_ms(ttl)} milliseconds")
        .groupBy(*group_cols)
        .applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    )


def start_sampler(
    events: DataFrame,
    group_cols: list[str],
    interval: str,
    watermark: str,
    counters: tuple[str, ...],
    buckets_path: str,
    checkpoint_root: str,
    sink,
    max_fields: tuple[str, ...] = (),
    ts_col: str = "timestamp",
    id_col: str = "_id",
    quotients: dict[str, tuple[str, str]] | None = None,
    ttl: str = "30d",
):
    """Start both stages; ``sink`` gets the rate stream's ``DataStreamWriter``
    to finish (format, options) and returns the started query.

    Returns ``(bucket_query, rate_query)``.
    """
    buckets = stream_buckets(events, group_cols, interval, watermark, ts_col, id_col, max_fields)
    q1 = (
        buckets.writeStream.outputMode("append")
        .format("parquet")
        .option("path", buckets_path)
        .option("checkpointLocation", f"{checkpoint_root}/buckets")
        .start()
    )
    spark = events.sparkSession
    stage2 = spark.readStream.schema(buckets.schema).parquet(buckets_path)
    rates = stream_rates(stage2, group_cols, counters, interval, quotients=quotients, ttl=ttl)
    q2 = sink(rates.writeStream.outputMode("append").option("checkpointLocation", f"{checkpoint_root}/rates"))
    return q1, q2
