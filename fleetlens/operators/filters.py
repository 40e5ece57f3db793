"""Row filters (F1-F16).  All are plain predicates or semi joins, so Catalyst
pushes the simple ones into the Parquet scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.nested import quote_path
from fleetlens.functions.scalars import matches_any_glob
from fleetlens.functions.timeutil import resolve_time_window, utc_literal


def metric_type_filter(df: DataFrame, metric_type: str, column: str = "metadata.name") -> DataFrame:
    """Metric-type equality (F1)."""
    return df.where(F.col(quote_path(column)) == metric_type)


def time_window(
    df: DataFrame,
    ts_col: str,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    hours: int = 1,
    now: datetime | None = None,
) -> DataFrame:
    """Keep rows with ``start <= ts <= end``, both ends inclusive.

    Text bounds follow ``parse_time_input``; a date-only end means 23:59:59
    of that day.  A missing end is now, a missing start is ``end - hours``.
    """
    lo = start if isinstance(start, datetime) else None
    hi = end if isinstance(end, datetime) else None
    if lo is None or hi is None:
        lo2, hi2 = resolve_time_window(
            hours,
            start if isinstance(start, str) else (lo.strftime("%Y-%m-%d %H:%M:%S") if lo else None),
            end if isinstance(end, str) else (hi.strftime("%Y-%m-%d %H:%M:%S") if hi else None),
            now,
        )
        lo, hi = lo or lo2, hi or hi2
    ts = F.col(quote_path(ts_col))
    return df.where((ts >= utc_literal(df, ts_col, lo)) & (ts <= utc_literal(df, ts_col, hi)))


def cluster_filter(df: DataFrame, column: str, cluster_ids: str | list[str]) -> DataFrame:
    """Cluster equality or IN list."""
    ids = [cluster_ids] if isinstance(cluster_ids, str) else list(cluster_ids)
    return df.where(F.col(quote_path(column)).isin(ids))


def target_predicate(id_col: Column, name_col: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Include/exclude glob rule over a cluster's id and name.

    An empty include list lets everything in; an include matches on id or
    name.  An exclude vetoes when it matches id or name (a deliberate
    tightening: a cluster excluded by id stays out whatever its name).
    """
    ok = F.lit(True)
    if include:
        ok = matches_any_glob(id_col, include) | matches_any_glob(name_col, include)
    if exclude:
        ok = ok & ~(matches_any_glob(id_col, exclude) | matches_any_glob(name_col, exclude))
    return ok


def glob_filter(df: DataFrame, column: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Glob include/exclude on one column (F6, F8 for node and index names)."""
    c = F.col(quote_path(column))
    return df.where(target_predicate(c, c, include, exclude))


def system_cluster(id_col: Column, name_col: Column, system_ids: list[str], name_words: list[str]) -> Column:
    """True for the console's own clusters: a listed id, or a name containing
    one of the marker words, case-insensitive (F9)."""
    cond = id_col.isin(system_ids) if system_ids else F.lit(False)
    upper = F.upper(F.coalesce(name_col, F.lit("")))
    for word in name_words:
        cond = cond | upper.contains(word.upper())
    return F.coalesce(cond, F.lit(False))


def exclude_system_clusters(
    df: DataFrame, system_ids: list[str], name_words: list[str], id_col: str = "id", name_col: str = "name"
) -> DataFrame:
    return df.where(~system_cluster(F.col(id_col), F.col(name_col), system_ids, name_words))


def exclude_system_indices(df: DataFrame, index_col: str = "index", include_system: bool = False) -> DataFrame:
    """Drop indices whose name starts with a dot unless asked."""
    if include_system:
        return df
    return df.where(~F.col(index_col).startswith("."))


def drop_unavailable_indices(df: DataFrame, health_col: str = "health") -> DataFrame:
    """Drop indices whose health is ``unavailable`` in any case."""
    return df.where(F.lower(F.coalesce(F.col(health_col), F.lit(""))) != "unavailable")


def drop_warmup(df: DataFrame, iteration_col: str = "iteration", warmup: int = 0) -> DataFrame:
    """Keep measured rounds only."""
    return df.where(F.col(iteration_col) > warmup)


def keyset_after(df: DataFrame, ts_col: str, id_col: str, cursor_ts: datetime, cursor_id) -> DataFrame:
    """Rows after a cursor in ``(ts desc, _id asc)`` order.

    The tie-break on ``_id`` means rows sharing the cursor's time are neither
    skipped nor repeated on resume.
    """
    ts = F.col(quote_path(ts_col))
    lit_ts = utc_literal(df, ts_col, cursor_ts)
    return df.where((ts < lit_ts) | ((ts == lit_ts) & (F.col(quote_path(id_col)) > F.lit(cursor_id))))


def drop_null_groups(df: DataFrame, group_cols: list[str]) -> DataFrame:
    """Rows with a null grouping value are not sampled (F16)."""
    cond = F.lit(True)
    for g in group_cols:
        cond = cond & F.col(quote_path(g)).isNotNull()
    return df.where(cond)


def restrict_to(df: DataFrame, keys: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """Keep rows whose key appears in ``keys`` (F7, J9), as a left semi join.

    Adaptive execution broadcasts ``keys`` when its measured size is under
    the broadcast threshold and falls back to a shuffled join otherwise; an
    empty key set yields an empty result, never a full export.
    """
    right_key = right_key or left_key
    k = keys.select(F.col(right_key).alias("__key")).distinct()
    return df.join(k, F.col(quote_path(left_key)) == F.col("__key"), "left_semi")
