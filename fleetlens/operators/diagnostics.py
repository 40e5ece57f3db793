"""Health diagnostics over exported metrics.

The reference documents these rules next to its metric field lists; here they
are column expressions and one bounded window (persistence over the last k
buckets of a series, or shard statistics within an index).  Thresholds are
parameters with the documented values as defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Documented thresholds.
HEAP_WARN_PERCENT = 75.0
HEAP_CRITICAL_PERCENT = 85.0
OLD_GC_PER_MINUTE_MAX = 1.0
CPU_PERCENT_MAX = 70.0
FD_PERCENT_MAX = 80.0
SEARCH_LATENCY_MS_MAX = 100.0
SHARDS_PER_GB_HEAP_MAX = 20.0
SHARD_SIZE_BYTES_MAX = 50 * 1024**3

GIB = float(1024**3)


def heap_level(percent: Column) -> Column:
    """``ok`` below 75 %, ``warning`` up to 85 %, ``critical`` above (D3)."""
    return (
        F.when(percent.isNull(), F.lit(None).cast("string"))
        .when(percent > HEAP_CRITICAL_PERCENT, F.lit("critical"))
        .when(percent > HEAP_WARN_PERCENT, F.lit("warning"))
        .otherwise(F.lit("ok"))
    )


def cluster_flags(report: DataFrame) -> DataFrame:
    """Cluster-level rules on the fleet report.

    red / yellow status, unassigned shards, shards per GB of heap (advised
    below 20), heap use above 75 %, and free disk bytes.
    """
    heap_gb = F.col("jvm_total_bytes").cast("double") / F.lit(GIB)
    per_gb = F.when(heap_gb > 0, F.col("total_shards").cast("double") / heap_gb)
    return report.select(
        "cluster_id",
        (F.col("health_status") == "red").alias("is_red"),
        (F.col("health_status") == "yellow").alias("is_yellow"),
        (F.col("unassigned_shards") > 0).alias("has_unassigned"),
        F.round(per_gb, 2).alias("shards_per_gb_heap"),
        F.coalesce(per_gb >= SHARDS_PER_GB_HEAP_MAX, F.lit(False)).alias("too_many_shards"),
        (F.col("jvm_used_percent") > HEAP_WARN_PERCENT).alias("heap_high"),
        (F.col("storage_total_bytes") - F.col("storage_used_bytes")).alias("disk_free_bytes"),
    )


def persistent_nonzero(value: Column, group_cols: list[str], order_col: str, buckets: int, interval_ms: int) -> Column:
    """True when ``value`` is above 0 in each of the last ``buckets`` buckets of
    the series, e.g. relocating shards that do not settle (D1); a missing
    bucket breaks the run.

    The frame is a range of bucket starts, at most ``buckets`` rows of a series
    that the sampler already reduced to one row per bucket.
    """
    w = Window.partitionBy(*group_cols).orderBy(order_col).rangeBetween(-(buckets - 1) * interval_ms, 0)
    full = F.count(F.lit(1)).over(w) == buckets
    return full & (F.min(F.coalesce(value, F.lit(0))).over(w) > 0)


def relocating_flags(sampled: DataFrame, group_cols: list[str], interval_ms: int, shards_col: str = "relocating_shards", buckets: int = 3, bucket_col: str = "bucket_ms") -> DataFrame:
    """Clusters whose relocating shards stay above 0 over the last ``buckets``
    buckets of sampled cluster health (D1)."""
    flag = persistent_nonzero(F.col(shards_col).cast("double"), group_cols, bucket_col, buckets, interval_ms)
    return sampled.select(*group_cols, bucket_col, F.col(shards_col), flag.alias("relocation_unsettled"))


def node_flags(
    sampled: DataFrame,
    group_cols: list[str],
    bucket_col: str = "bucket_ms",
    heap_percent: str | None = None,
    old_gc_rate: str | None = None,
    cpu_percent: str | None = None,
    fd_open: str | None = None,
    fd_max: str | None = None,
    swap_used: str | None = None,
    breakers_tripped: str | None = None,
    search_latency: str | None = None,
    persist_col: str | None = None,
    persist_buckets: int = 3,
    interval_ms: int = 900_000,
) -> DataFrame:
    """Node rules on sampled node stats (D3-D8); absent inputs give null flags.

    ``old_gc_rate`` is a per-second rate from the sampler, so the per-minute
    frequency is ``rate * 60`` (D4).
    """

    def c(name: str | None) -> Column:
        return F.col(name).cast("double") if name else F.lit(None).cast("double")

    fd_pct = F.when(c(fd_max) > 0, c(fd_open) / c(fd_max) * 100.0)
    cols = [
        *group_cols,
        bucket_col,
        heap_level(c(heap_percent)).alias("heap_level"),
        (c(old_gc_rate) * 60.0 >= OLD_GC_PER_MINUTE_MAX).alias("old_gc_frequent"),
        (c(cpu_percent) >= CPU_PERCENT_MAX).alias("cpu_high"),
        (fd_pct >= FD_PERCENT_MAX).alias("fd_high"),
        (c(swap_used) != 0).alias("swap_used"),
        (c(breakers_tripped) != 0).alias("breaker_tripped"),
        (c(search_latency) > SEARCH_LATENCY_MS_MAX).alias("search_slow"),
    ]
    if persist_col:
        cols.append(persistent_nonzero(c(persist_col), group_cols, bucket_col, persist_buckets, interval_ms).alias("persistent"))
    return sampled.select(*cols)


def index_flags(indices: DataFrame, docs_col: str = "docs_count", deleted_col: str = "docs_deleted", max_deleted_share: float = 0.1) -> DataFrame:
    """Deleted-document share and force-merge candidates."""
    total = F.col(docs_col).cast("double") + F.col(deleted_col).cast("double")
    share = F.when(total > 0, F.col(deleted_col).cast("double") / total)
    return indices.select("*", F.round(share, 4).alias("deleted_share"), F.coalesce(share > max_deleted_share, F.lit(False)).alias("force_merge_candidate"))


def shard_flags(
    shards: DataFrame,
    index_cols: list[str],
    size_col: str = "size_in_bytes",
    docs_col: str = "docs_count",
    max_size: int = SHARD_SIZE_BYTES_MAX,
    max_docs: int = 200_000_000,
) -> DataFrame:
    """Shard size skew within an index, shards over 50 GB, too many docs.

    Per-index max and average come from a partial aggregate (a hot index is
    combined map-side) and are joined back on the index key; that side has
    one row per index, so adaptive execution can broadcast it once measured.
    """
    size = F.col(size_col).cast("double")
    stats = shards.groupBy(*index_cols).agg(F.max(size).alias("__max"), F.avg(size).alias("__avg"))
    j = shards.join(stats, index_cols, "left")
    return j.select(
        *shards.columns,
        F.round(F.col("__max") / F.col("__avg"), 4).alias("size_skew"),
        (F.col(size_col) > max_size).alias("too_large"),
        (F.col(docs_col) > max_docs).alias("too_many_docs"),
    )
