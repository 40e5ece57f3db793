"""Report tables with fixed columns (K8, K9, K12, K13); the sinks write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import benchruns

# The 18 columns of the cluster report, in order.
CLUSTER_COLUMNS = (
    "display_name cluster_name version health_status available uptime nodes_count indices_count primary_shards total_shards "
    "unassigned_shards documents_count storage_used_formatted storage_total_formatted jvm_used_formatted jvm_total_formatted "
    "jvm_used_percent collection_time"
).split()

# The columns of the run detail table, in order.
RUN_COLUMNS = "iteration is_warmup query_type name took duration status".split()

# What the two measured fields of a run mean.
FIELD_NOTES = {
    "duration": "time from sending a request to its response, in milliseconds",
    "took": "time spent inside the search engine, in milliseconds; search requests only",
}


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def cluster_rows(report: DataFrame, collected: Column) -> DataFrame:
    """The cluster report's rows (K8); ``collected`` is the collection time."""
    full = report.withColumns({"available": yes_no(F.col("available")), "collection_time": collected})
    return full.select(*CLUSTER_COLUMNS)


def index_rows(indices: DataFrame, samples: DataFrame) -> DataFrame:
    """The sampling report's rows (K9): every index with a mapping flag and the
    number of its sample documents (counted first, so no list is built)."""
    counted = samples.groupBy("cluster_id", "index_name").agg(F.count(F.lit(1)).alias("sample_count"))
    joined = indices.join(counted, ["cluster_id", "index_name"], "left")
    return joined.withColumns({"has_mapping": yes_no(F.col("mapping").isNotNull()), "sample_count": F.coalesce("sample_count", F.lit(0))}).drop("mapping")


def run_rows(runs: DataFrame) -> DataFrame:
    """One row per execution (K12, detail part)."""
    full = runs.withColumns({"is_warmup": yes_no(F.col("is_warmup")), "status": F.when(F.col("success"), "success").otherwise("failure")})
    return full.select(*RUN_COLUMNS)


def run_statistics(runs: DataFrame) -> DataFrame:
    """Mean, least, largest and sum over the measured rounds' totals, per side
    and measure (K12, statistics part)."""
    rounds = benchruns.round_series(runs)
    long = rounds.select("query_type", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_total").cast("double").alias("total")) for m in ("took", "duration")])))
    total = F.col("total")
    return long.groupBy("query_type", "measure").agg(
        F.coalesce(F.round(F.avg(total), 2), F.lit(0.0)).alias("avg"),
        F.coalesce(F.min(total), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(total), F.lit(0.0)).alias("max"),
        F.coalesce(F.round(F.sum(total), 2), F.lit(0.0)).alias("sum"),
    )


def report_record(runs: DataFrame, created: Column) -> DataFrame:
    """One row: time, summary, what the fields mean (K13).  The results are
    the run rows beside it: a list of all runs in one row would not be bounded."""
    summary = benchruns.run_summary(benchruns.measured(runs))
    notes = F.create_map(*[F.lit(x) for pair in FIELD_NOTES.items() for x in pair])
    return summary.select(created.alias("timestamp"), F.struct("*").alias("summary"), notes.alias("field_descriptions"))
