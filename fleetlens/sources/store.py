"""Metric store: one partitioned and bucketed table per metric type.

Documents are laid out by what the sampler groups by.  ``series`` is a hash of
the group fields, ``slot`` the day; files are bucketed by both and sorted by
series and time, below folders by ``day``.  A time window reads the folders it
needs, and because all rows of a (series, day) lie in one bucket, sampling in
buckets that divide a day aggregates without an exchange.  Bucketing by the day
as well as the series spreads a series with a third of all rows.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.nested import quote_path
from fleetlens.functions.timeutil import epoch_micros, parse_interval_ms, parse_time_input
from fleetlens.operators.filters import time_window
from fleetlens.operators.sampling import FieldRules, sample_buckets

DAY_MS = 86_400_000
SERIES, SLOT, DAY = "series", "slot", "day"


def write_metric_store(df: DataFrame, table: str, group_cols: list[str], buckets: int, ts_col: str = "timestamp", path: str | None = None, mode: str = "errorifexists") -> None:
    """Write documents as the table ``table``.

    ``buckets`` should make a bucket of one day some hundred MB.  ``path`` puts
    the files outside the warehouse.  One task writes one bucket of one day, so
    there are at most ``buckets`` files a day.
    """
    taken = {SERIES, SLOT, DAY} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are used by the store")
    slot = F.floor(epoch_micros(df, ts_col) / (DAY_MS * 1000)).cast("int")
    keyed = df.withColumns(
        {
            SERIES: F.xxhash64(*[F.col(quote_path(g)).cast("string") for g in group_cols]),
            SLOT: slot,
            DAY: F.date_from_unix_date(slot),
        }
    )
    dealt = keyed.repartition(buckets, SERIES, SLOT)
    writer = dealt.write.mode(mode).format("parquet").partitionBy(DAY).bucketBy(buckets, SERIES, SLOT).sortBy(SERIES, ts_col)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def read_metric_store(spark: SparkSession, table: str, start: datetime | str | None = None, end: datetime | str | None = None, ts_col: str = "timestamp") -> DataFrame:
    """The table's documents in a time window (inclusive); days are pruned."""
    df = spark.table(table)
    if start is None and end is None:
        return df
    bounded = time_window(df, ts_col, start, end)
    for bound, keep in ((start, F.col(DAY).__ge__), (end, F.col(DAY).__le__)):
        if bound is not None:
            instant = parse_time_input(bound) if isinstance(bound, str) else bound
            bounded = bounded.where(keep(F.lit(instant.astimezone(timezone.utc).date())))
    return bounded


def sample_store(df: DataFrame, group_cols: list[str], interval: str | int, rules: FieldRules | None = None, **options) -> DataFrame:
    """:func:`sample_buckets` over documents of the store, without the layout's
    columns in the result.

    Buckets that divide a day stay inside a (series, day): step one of the
    sampler needs no exchange, and counters are carried day by day.  Longer or
    odd intervals are sampled as any other input.
    """
    if DAY_MS % parse_interval_ms(interval) == 0:
        out = sample_buckets(df, group_cols, interval, rules, layout=(SERIES, SLOT), **options)
    else:
        out = sample_buckets(df, group_cols, interval, rules, **options)
    return out.drop(SERIES, SLOT, DAY)
