"""Benchmark-run analytics.

Input: one row per query execution with ``name, base_name, query_type,
query_index, iteration, is_warmup, measured_iteration, took, duration,
success``.  ``took`` counts when not null; ``duration`` only on success.
All outputs are conditional aggregates: one shuffle each, combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIGINAL, OPTIMIZED = "original", "optimized"


def measured(runs: DataFrame) -> DataFrame:
    """Drop warm-up rounds."""
    return runs.where(~F.coalesce(F.col("is_warmup"), F.lit(False)))


def number_rounds(runs: DataFrame, warmup: int = 0, iteration_col: str = "iteration") -> DataFrame:
    """Mark the first ``warmup`` rounds and number the measured ones from 1."""
    it = F.col(iteration_col)
    return runs.withColumns({"is_warmup": it <= warmup, "measured_iteration": F.when(it > warmup, it - warmup)})


def _ok_duration() -> Column:
    return F.when(F.col("success"), F.col("duration"))


def _stats(value: Column, prefix: str) -> list[Column]:
    """avg (2 dp), min, max over non-null values; 0 when there are none."""
    return [
        F.coalesce(F.round(F.avg(value), 2), F.lit(0.0)).alias(f"avg_{prefix}"),
        F.coalesce(F.min(value), F.lit(0.0)).cast("double").alias(f"min_{prefix}"),
        F.coalesce(F.max(value), F.lit(0.0)).cast("double").alias(f"max_{prefix}"),
    ]


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals, pass rate and per-side sums in one global aggregate.

    Sides are told apart by ``query_type``, not by words inside the name.
    """
    dur = _ok_duration()
    took = F.col("took")
    orig = F.col("query_type") == ORIGINAL
    opt = F.col("query_type") == OPTIMIZED
    agg = runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("success")).alias("passed"),
        *_stats(dur, "duration"),
        *_stats(took, "took"),
        F.round(F.coalesce(F.sum(dur), F.lit(0.0)), 2).alias("total_duration_sum"),
        F.round(F.coalesce(F.sum(took), F.lit(0.0)), 2).alias("total_took_sum"),
        F.round(F.coalesce(F.sum(F.when(orig, dur)), F.lit(0.0)), 2).alias("original_duration_sum"),
        F.round(F.coalesce(F.sum(F.when(orig, took)), F.lit(0.0)), 2).alias("original_took_sum"),
        F.count(F.when(orig, took)).alias("original_took_count"),
        F.coalesce(F.round(F.avg(F.when(orig, took)), 2), F.lit(0.0)).alias("original_avg_took"),
        F.round(F.coalesce(F.sum(F.when(opt, dur)), F.lit(0.0)), 2).alias("optimized_duration_sum"),
        F.round(F.coalesce(F.sum(F.when(opt, took)), F.lit(0.0)), 2).alias("optimized_took_sum"),
        F.count(F.when(opt, took)).alias("optimized_took_count"),
        F.coalesce(F.round(F.avg(F.when(opt, took)), 2), F.lit(0.0)).alias("optimized_avg_took"),
    )
    return agg.select(
        "*",
        (F.col("total") - F.col("passed")).alias("failed"),
        F.when(F.col("total") > 0, F.concat(F.format_number(F.col("passed") / F.col("total") * 100.0, 2), F.lit("%")))
        .otherwise(F.lit("0.00%"))
        .alias("pass_rate"),
    )


def per_query_stats(runs: DataFrame) -> DataFrame:
    """Per query name: count, avg, min, max of duration and took.

    Ordered by position, original before optimized, then name; queries without
    a position follow, by base name and side.
    """
    dur = _ok_duration()
    took = F.col("took")
    g = runs.groupBy("name").agg(
        F.min("query_index").alias("query_index"),
        F.min("query_type").alias("query_type"),
        F.min("base_name").alias("__base"),
        F.count(dur).alias("duration_count"),
        *_stats(dur, "duration"),
        F.count(took).alias("took_count"),
        *_stats(took, "took"),
    )
    type_order = F.when(F.col("query_type") == ORIGINAL, 0).otherwise(1)
    base = F.when(F.col("query_index").isNull(), F.col("__base"))
    return g.orderBy(F.col("query_index").asc_nulls_last(), base, type_order, F.col("name")).drop("__base")


def round_series(runs: DataFrame) -> DataFrame:
    """Per measured round and side: mean and total of took and duration.

    A side without a valid value in a round gets nulls, as the chart series do.
    """
    m = measured(runs).where(F.col("query_type").isin(ORIGINAL, OPTIMIZED))
    dur = _ok_duration()
    return m.groupBy("measured_iteration", "query_type").agg(
        F.avg("took").alias("took_avg"),
        F.sum("took").alias("took_total"),
        F.avg(dur).alias("duration_avg"),
        F.sum(dur).alias("duration_total"),
    )


def compare_sides(runs: DataFrame) -> DataFrame:
    """Original vs optimized per base name.

    Both sides must exist.  ``took`` is compared when both sides have took
    values, else ``duration``.  Improvement % divides by the original average
    and is null when that average is 0.
    """
    m = measured(runs)
    orig = F.col("query_type") == ORIGINAL
    opt = F.col("query_type") == OPTIMIZED
    dur = _ok_duration()
    g = m.groupBy("base_name").agg(
        F.count_if(orig).alias("n_orig"),
        F.count_if(opt).alias("n_opt"),
        F.avg(F.when(orig, F.col("took"))).alias("orig_took"),
        F.avg(F.when(opt, F.col("took"))).alias("opt_took"),
        F.avg(F.when(orig, dur)).alias("orig_dur"),
        F.avg(F.when(opt, dur)).alias("opt_dur"),
    ).where((F.col("n_orig") > 0) & (F.col("n_opt") > 0))
    use_took = F.col("orig_took").isNotNull() & F.col("opt_took").isNotNull()
    a = F.when(use_took, F.col("orig_took")).otherwise(F.col("orig_dur"))
    b = F.when(use_took, F.col("opt_took")).otherwise(F.col("opt_dur"))
    g = g.select(
        "base_name",
        F.when(use_took, F.lit("took")).otherwise(F.lit("duration")).alias("metric"),
        a.alias("a"),
        b.alias("b"),
    ).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    improvement = F.try_divide(F.col("a") - F.col("b"), F.nullif(F.col("a"), F.lit(0.0))) * F.lit(100.0)
    return g.select(
        "base_name",
        "metric",
        F.round(F.col("a"), 2).alias("avg_original"),
        F.round(F.col("b"), 2).alias("avg_optimized"),
        F.round(improvement, 2).alias("improvement_percent"),
        (improvement > 0).alias("is_faster"),
    )


def pair_matrix(runs: DataFrame, order_col: str = "seq") -> DataFrame:
    """Query pair x measured round, both sides side by side.

    Sides are matched by position (``query_index``); unequal query lists are
    kept.  A cell that was executed several times shows its last execution by
    ``order_col``.  One pass: both sides are conditional aggregates.
    """
    order = F.col(order_col)
    m = measured(runs).where(F.col("query_type").isin(ORIGINAL, OPTIMIZED))
    m = m.select("query_index", "measured_iteration", "query_type", "base_name", F.col("took").cast("double").alias("took"), _ok_duration().cast("double").alias("duration"), order.alias("__order"))
    aggs = []
    for kind in (ORIGINAL, OPTIMIZED):
        mine = F.col("query_type") == kind
        aggs.append(F.max(F.when(mine, F.struct("__order", "base_name", "took", "duration"))).alias(kind))
    j = m.groupBy("query_index", "measured_iteration").agg(*aggs).select(
        "query_index",
        "measured_iteration",
        *[F.col(f"{kind}.{c}").alias(f"{kind}_{n}") for kind in (ORIGINAL, OPTIMIZED) for c, n in (("base_name", "name"), ("took", "took"), ("duration", "duration"))],
    )
    on, pn = F.col(f"{ORIGINAL}_name"), F.col(f"{OPTIMIZED}_name")
    display = (
        F.when(on.isNotNull() & pn.isNotNull() & (on != pn), F.concat(on, F.lit(" vs "), pn))
        .otherwise(F.coalesce(on, pn, F.concat(F.lit("Query "), (F.col("query_index") + 1).cast("string"))))
    )
    return j.select(
        "query_index",
        "measured_iteration",
        display.alias("display_name"),
        f"{ORIGINAL}_took",
        f"{OPTIMIZED}_took",
        f"{ORIGINAL}_duration",
        f"{OPTIMIZED}_duration",
    )


def _numeric(v: Column) -> Column:
    """A VARIANT number as double; text, booleans and objects give null."""
    kind = F.schema_of_variant(v)
    is_num = kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | kind.startswith("DECIMAL")
    return F.when(is_num, F.try_variant_get(v, "$", "double"))


def took_from_response(path: Column, body: Column) -> Column:
    """Took of a response (A32): for multi-search the largest numeric
    sub-response took, else the top-level took; non-numbers are null.

    ``body`` is a VARIANT (``try_parse_json`` of the response text).
    """
    from fleetlens.functions.scalars import is_msearch_path

    top = _numeric(F.try_variant_get(body, "$.took", "variant"))
    subs = F.try_variant_get(body, "$.responses", "array<variant>")
    sub_tooks = F.filter(F.transform(subs, lambda r: _numeric(F.try_variant_get(r, "$.took", "variant"))), lambda x: x.isNotNull())
    return F.when(is_msearch_path(path), F.coalesce(F.array_max(sub_tooks), top)).otherwise(top)
