"""Registered queries: one callable per operator family, ``(spark, sf_dir) -> DataFrame``.

Each reads whole driver tables through ``fleetlens.sources.adaptors`` and
runs the library operators on them.  ``fleetlens.plans.oracle`` restates each
one in DuckDB SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.fieldspec import classify_fields
from fleetlens.functions.nested import flatten, get_path
from fleetlens.operators import estimate, filters, sampling, shape
from fleetlens.plans.job import ExportJob, manifest, newest, run_export_job, summary_totals
from fleetlens.session import fresh_folder, materialized, write_shared
from fleetlens.sinks import writers
from fleetlens.sources import adaptors, store
from fleetlens.sources.tables import normalize_registry, read_alerts, read_runs, table

NODE_GROUP = ["cluster_id", "node_id"]
COUNTER_RULES = sampling.FieldRules(rate=("ops", "time_ms"))
LATENCY_RULES = sampling.FieldRules(latency={"latency_ms": ("time_ms", "ops")})
FULL_RULES = sampling.FieldRules(
    rate=("ops", "time_ms"),
    latency={"latency_ms": ("time_ms", "ops")},
    max=("value",),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# --- time-bucket sampling (flagship) ----------------------------------------


@register
def sample_latest_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest node document per hour."""
    m = adaptors.metrics(spark, sf_dir)
    s = sampling.latest_per_bucket(m, NODE_GROUP, "1h")
    return s.select("cluster_id", "node_id", "bucket_ms", "_id", "timestamp", "status", "value", "ops", "time_ms")


@register
def sample_max_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bucket maximum of the gauge next to the newest snapshot."""
    m = adaptors.metrics(spark, sf_dir)
    s = sampling.sample_buckets(m, NODE_GROUP, "1d", sampling.FieldRules(max=("value",)), fields=["value"])
    return s.select("cluster_id", "node_id", "bucket_ms", "_id", "timestamp", "value")


@register
def sample_documents_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested node documents sampled by the default field table."""
    docs = adaptors.metric_documents(spark, sf_dir)
    rules = classify_fields(docs.schema, "node_stats")
    s = sampling.sample_buckets(docs, ["metadata.labels.cluster_id", "metadata.labels.node_id"], "1h", rules)
    root = "payload.elasticsearch.node_stats"
    return s.select(
        "metadata.labels.cluster_id",
        "metadata.labels.node_id",
        "bucket_ms",
        "_id",
        f"{root}.indices.search.query_total",
        f"{root}.indices.search.query_time_in_millis",
        f"{root}.indices.search.query_latency",
        f"{root}.jvm.mem.heap_used_in_bytes",
        f"{root}.indices.store.size_in_bytes",
    )


@register
def rate_with_reset_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly reset-aware counter rates."""
    m = adaptors.metrics(spark, sf_dir)
    s = sampling.sample_buckets(m, NODE_GROUP, "1h", COUNTER_RULES, fields=["ops", "time_ms"])
    return s.select("cluster_id", "node_id", "bucket_ms", "_id", "ops", "time_ms")


@register
def latency_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: hourly average latency delta(time)/delta(count)."""
    m = adaptors.metrics(spark, sf_dir)
    s = sampling.sample_buckets(m, NODE_GROUP, "1h", LATENCY_RULES, fields=["ops", "time_ms", "latency_ms"])
    return s.select("cluster_id", "node_id", "bucket_ms", "_id", "ops", "time_ms", "latency_ms")


@register
def ratio_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of two counters' deltas, delta(ops) / delta(time_ms), hourly."""
    m = adaptors.metrics(spark, sf_dir)
    s = sampling.sample_buckets(m, NODE_GROUP, "1h", sampling.FieldRules(ratio={"ops_per_time": ("ops", "time_ms")}), fields=["ops_per_time"])
    return s.select("cluster_id", "node_id", "bucket_ms", "_id", "ops_per_time")


@register
def sample_full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A7 + P1: the whole sampler at 15-minute buckets, then a projection."""
    m = adaptors.metrics(spark, sf_dir)
    s = sampling.sample_buckets(m, NODE_GROUP, "15m", FULL_RULES)
    return s.select(
        "cluster_id", "node_id", "bucket_ms", "_id", "timestamp", "metric_type", "status", "value", "ops", "time_ms", "latency_ms"
    )


@register
def sample_blocked_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampler with series cut into blocks of a day."""
    m = adaptors.metrics(spark, sf_dir)
    s = sampling.sample_buckets(m, NODE_GROUP, "15m", FULL_RULES, carry_block=96)
    return s.select(
        "cluster_id", "node_id", "bucket_ms", "_id", "timestamp", "metric_type", "status", "value", "ops", "time_ms", "latency_ms"
    )


@register
def sample_store_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics written as a bucketed store, sampled from there
    without an exchange of documents."""
    name = f"metrics_{uuid.uuid4().hex}"
    store.write_metric_store(adaptors.metrics(spark, sf_dir), name, NODE_GROUP, buckets=16, path=fresh_folder(spark, name))
    s = store.sample_store(store.read_metric_store(spark, name, "2024-01-01", "2024-12-31"), NODE_GROUP, "15m", FULL_RULES)
    return s.select(
        "cluster_id", "node_id", "bucket_ms", "_id", "timestamp", "metric_type", "status", "value", "ops", "time_ms", "latency_ms"
    )


@register
def sample_text_max_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: a text field among the maxima keeps the newest document's value."""
    m = adaptors.metrics(spark, sf_dir)
    s = sampling.sample_buckets(m, NODE_GROUP, "1d", sampling.FieldRules(max=("status", "value")), fields=["status", "value"])
    return s.select("cluster_id", "node_id", "bucket_ms", "_id", "status", "value")


@register
def sample_avg_mode_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented fallback -- bucket average for numbers, most frequent text."""
    m = adaptors.metrics(spark, sf_dir).select("_id", "timestamp", "cluster_id", "node_id", "status", "value")
    s = sampling.sample_buckets(m, NODE_GROUP, "1d", fallback="avg_mode")
    return s.select("cluster_id", "node_id", "bucket_ms", "_id", "timestamp", "status", F.round("value", 6).alias("value"))


@register
def estimate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, exact groups, buckets and the estimated sample size."""
    m = adaptors.metrics(spark, sf_dir)
    lo = datetime(2024, 1, 1, tzinfo=timezone.utc)
    hi = datetime(2024, 1, 30, 23, 59, 59, tzinfo=timezone.utc)
    w = filters.time_window(m, "timestamp", lo, hi)
    return estimate.estimate_sample_size(w, NODE_GROUP, "1h", lo, hi)


@register
def estimate_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketched group count lies within three times its stated error
    of the exact one."""
    m = adaptors.metrics(spark, sf_dir)
    lo, hi = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 1, 30, 23, 59, 59, tzinfo=timezone.utc)
    exact, close = (estimate.estimate_sample_size(m, NODE_GROUP, "1h", lo, hi, exact=e) for e in (True, False))
    near = F.abs(F.col("b.groups") - F.col("a.groups")) <= 3 * estimate.DEFAULT_RSD * F.col("a.groups") + 1
    return exact.alias("a").join(close.alias("b"), F.col("a.rows") == F.col("b.rows")).select("a.rows", "a.groups", near.alias("within_error"))


@register
def estimate_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored daily sketches per cluster; two windows answered by them."""
    m = adaptors.metrics(spark, sf_dir)
    stored = write_shared(estimate.group_sketches(m, ["cluster_id"], NODE_GROUP), "sketches")

    def window(first: int, last: int) -> DataFrame:
        lo, hi = datetime(2024, 1, first, tzinfo=timezone.utc), datetime(2024, 1, last, tzinfo=timezone.utc)
        e = estimate.estimate_from_sketches(stored, ["cluster_id"], "1h", lo, hi)
        return e.select(F.lit(last).alias("until"), "cluster_id", "rows", "buckets", "groups", "estimate")

    found = window(1, 10).unionByName(window(1, 30))
    # groups to the sketch's error band: exact below a hundred, two digits above
    digits = F.greatest(F.length(F.col("groups").cast("string")) - 2, F.lit(0)).cast("double")
    return found.select("until", "cluster_id", "rows", "buckets", (F.round(F.col("groups") / F.pow(F.lit(10.0), digits)) * F.pow(F.lit(10.0), digits)).cast("bigint").alias("groups"))


@register
def sample_null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series without a node id are not sampled; an all-null candidate
    is no group column."""
    m = adaptors.metrics(spark, sf_dir)
    m = m.withColumns({"node_id": F.when(F.col("node_id") % 3 != 0, F.col("node_id")), "rack": F.lit(None).cast("string")})
    groups = sampling.resolve_group_columns(m, ["cluster_id", "node_id", "rack"])
    return sampling.sample_buckets(m, groups, "1d", fields=["status"]).select("cluster_id", "node_id", "bucket_ms", "_id", "status")


@register
def full_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an interval every document is exported."""
    m = adaptors.metrics(spark, sf_dir)
    return sampling.sample_buckets(m, NODE_GROUP, None).select("_id", "timestamp", "cluster_id", "node_id", "status", "value")


# Two time slices that overlap by a day and a half, cut inside an hour.
SLICES = ((None, "2024-01-16 10:20:00"), ("2024-01-14 22:40:00", None))


@register
def sample_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of two overlapping time slices put together as they
    are, then one row per series and bucket with the number of slices it is from."""
    m = adaptors.metrics(spark, sf_dir)
    at = F.col("timestamp")
    parts = [m.where((at >= low if low else F.lit(True)) & (at < high if high else F.lit(True))) for low, high in SLICES]
    early, late = (sampling.latest_per_bucket(p, NODE_GROUP, "1h") for p in parts)
    both = early.unionByName(late)
    outputs = both.groupBy(*NODE_GROUP, "bucket_ms").agg(F.count(F.lit(1)).alias("outputs"))
    once = sampling.latest_per_bucket(both.drop("bucket_ms"), NODE_GROUP, "1h")
    return once.join(outputs, [*NODE_GROUP, "bucket_ms"]).select(*NODE_GROUP, "bucket_ms", "_id", "status", "value", "outputs")


@register
def newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 newest documents, ties by id (a top-k report)."""
    return newest(adaptors.metrics(spark, sf_dir), "timestamp", 500).select("_id", "timestamp", "status")


@register
def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric type of listed clusters, documents per node."""
    docs = filters.metric_type_filter(adaptors.metric_documents(spark, sf_dir), "node_stats")
    docs = filters.cluster_filter(docs, "metadata.labels.cluster_id", ["1", "4", "6"])
    return docs.groupBy("metadata.labels.cluster_id", "metadata.labels.node_id").agg(F.count(F.lit(1)).alias("docs"))


# What the export declares of a node document; the rest is kept undeclared.
EXPORT_SCHEMA = (
    "_id string, timestamp timestamp, agent struct<id string>, metadata struct<name string, category string, datatype string, labels struct<cluster_id string, node_id string>>, "
    "payload struct<elasticsearch struct<node_stats struct<indices struct<search struct<query_total long, query_time_in_millis long>, store struct<size_in_bytes long>>>>>"
)


def _run(spark: SparkSession, job: ExportJob) -> ExportJob:
    failed = run_export_job(spark, job).where("error is not null").first()
    if failed:
        raise RuntimeError(failed["error"])
    return job


@register
def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exported by the job, with their undeclared
    fields, and read back from its files."""
    job = ExportJob(
        name="rest",
        output_path=fresh_folder(spark, "export"),
        metrics_path=adaptors.metric_lines(spark, sf_dir),
        metrics_format="json",
        metric_types=["node_stats"],
        schemas={"node_stats": T.StructType.fromDDL(EXPORT_SCHEMA)},
        start="2024-1-1",
        end="2024-12-31",
        keep_rest=True,
        mask=True,
        slim=shape.SlimConfig(enabled=True),
        split_by="cluster",
    )
    _run(spark, job)
    lines = spark.read.option("basePath", f"{job.output_path}/node_stats").text(f"{job.output_path}/node_stats")
    # every line is parsed once; texts, numbers and arrays alike are picked as texts
    picked = (
        "timestamp string, metadata struct<labels struct<node_id string, zone string>>, free struct<store string, seen string>, payload struct<elasticsearch struct<node_stats struct<"
        "transport struct<publish_address string>, indices struct<store struct<size string, size_in_bytes string>, search struct<query_total string>>>>>"
    )
    docs = materialized(lines.select(F.col("cluster").cast("string").alias("cluster_id"), F.from_json("value", picked).alias("d")))
    node = "d.payload.elasticsearch.node_stats"
    return docs.select(
        "cluster_id",
        F.substring("d.timestamp", 1, 19).alias("at"),
        "d.metadata.labels.node_id",
        "d.metadata.labels.zone",
        "d.free.store",
        "d.free.seen",
        F.col(f"{node}.transport.publish_address").alias("publish"),
        f"{node}.indices.store.size",
        F.col(f"{node}.indices.store.size_in_bytes").alias("bytes"),
        F.col(f"{node}.indices.search.query_total").alias("queries"),
    )


@register
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's slices as entered and as counted in its files."""
    store_path = fresh_folder(spark, "metric-documents")
    adaptors.metric_documents(spark, sf_dir).write.parquet(store_path)
    job = ExportJob(
        name="sliced",
        output_path=fresh_folder(spark, "export"),
        metrics_path=store_path,
        metric_types=["node_stats"],
        start="2024-1-1",
        end="2024-2-10",
        slice_interval="14d",
        split_by="cluster",
        full_files=True,
        rows_per_file=1000,
    )
    _run(spark, job)
    counts = writers.file_row_counts(spark, f"{job.output_path}/node_stats")
    name = F.regexp_extract("file", "slice=([0-9T]+)", 1)
    read = counts.groupBy(name.alias("slice")).agg(F.sum("rows").alias("rows_read"), F.max("rows").alias("most"))
    entered = manifest(spark, job.output_path).where("rows > 0").select(F.date_format("low", "yyyyMMdd'T'HHmmss").alias("slice"), "type", "rows", "last_time")
    return entered.join(read, "slice").select("slice", "type", "rows", "rows_read", (F.col("most") <= job.rows_per_file).alias("capped"), F.date_format("last_time", "yyyy-MM-dd HH:mm:ss").alias("last_time"))


@register
def export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of nodes chosen by globs, exported beside a
    type that has none; the summary per type, its totals, and the rows read back."""
    store_path = fresh_folder(spark, "metric-documents")
    adaptors.metric_documents(spark, sf_dir).write.parquet(store_path)
    job = ExportJob(
        name="nodes",
        output_path=fresh_folder(spark, "export"),
        metrics_path=store_path,
        metric_types=["node_stats", "index_stats"],
        start="2024-1-1",
        end="2024-12-31",
        include_nodes=["node-1*", "node-?"],
        exclude_nodes=["*[37]"],
    )
    summary = run_export_job(spark, job)
    read = None
    for name in job.metric_types:
        folder = f"{job.output_path}/{name}"
        some = bool(spark.read.text(folder).inputFiles())
        one = spark.read.text(folder).agg(F.count(F.lit(1)).alias("rows_read")).select(F.lit(name).alias("type"), "rows_read", F.lit(some).alias("has_file"))
        read = one if read is None else read.unionByName(one)
    failed = F.col("error").isNotNull().cast("long").alias("failed_types")
    each = summary.join(read, "type").select("type", "rows", failed, "rows_read", "has_file")
    totals = summary_totals(summary).select(F.lit("all").alias("type"), "rows", "failed_types")
    return each.unionByName(totals, allowMissingColumns=True)


# --- document shaping ---------------------------------------------------------


@register
def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at dotted paths; paths that are absent, or that lead through a
    scalar, read null."""
    docs = adaptors.metric_documents(spark, sf_dir)
    paths = {
        "node": "metadata.labels.node_name",
        "queries": "payload.elasticsearch.node_stats.indices.search.query_total",
        "cpu": "payload.elasticsearch.node_stats.os.cpu.percent",
        "through": "metadata.name.first",
    }
    return docs.select("_id", *[get_path(docs.schema, p).cast("string").alias(c) for c, p in paths.items()])


@register
def mask_ip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 over whole document texts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", shape.mask_ipv4("text").alias("text"))


@register
def mask_ip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 over whole raw web pages and their URLs."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", shape.mask_ipv4("url").alias("url"), shape.mask_ipv4("html").alias("html"))


SLIM_FIELDS = ["timestamp", "metadata", "payload.elasticsearch.node_stats.indices", "payload.elasticsearch.node_stats.transport"]


@register
def slim_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1-P5 + P8: mask, slim, project, then flatten the nested documents."""
    docs = adaptors.metric_documents(spark, sf_dir)
    shaped = shape.shape_documents(docs, SLIM_FIELDS, mask=True, slim=shape.SlimConfig(enabled=True))
    return flatten(shaped)


VARIANT_FIELDS = ["addr", "disk", "list.at", "list.limit_size", "props.k", "store"]


@register
def variant_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 P3 P4 on VARIANT: free-form documents masked, slimmed and projected."""
    m = adaptors.free_documents(spark, sf_dir)
    shaped = shape.shape_documents(m, ["event_id", *[f"doc.{f}" for f in VARIANT_FIELDS]], mask=True, slim=shape.SlimConfig(enabled=True))
    return shaped.select("event_id", F.to_json("doc").alias("doc"))


# --- filters ------------------------------------------------------------------


def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as alert messages: ``created`` = order date, rule = customer."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("_id"),
        F.col("o_custkey").alias("rule_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("created"),
    )


@register
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive time window on the alert time column (date-only end)."""
    msgs = alert_messages(spark, sf_dir)
    lo = filters.time_window(msgs, "created", "1995-01-01", "1995-12-31")
    return lo.select("_id", "rule_id", "status", "created")


@register
def keyset_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume after a (created desc, _id asc) cursor."""
    msgs = alert_messages(spark, sf_dir)
    cur = datetime(1996, 6, 1, tzinfo=timezone.utc)
    return filters.keyset_after(msgs, "created", "_id", cur, 30000).select("_id", "created")


# --- fleet inventory ----------------------------------------------------------

# Markers of the console's own system clusters in the registry adaptor.
SYSTEM_IDS: list[str] = []
SYSTEM_NAME_WORDS = ["CONSOLE-SYSTEM"]


@register
def active_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by document count with their most frequent name."""
    from fleetlens.operators import fleet

    return fleet.active_clusters(adaptors.metrics(spark, sf_dir))


def _fleet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.operators import fleet

    return fleet.fleet_report(
        adaptors.registry(spark, sf_dir),
        adaptors.cluster_status(spark, sf_dir),
        adaptors.cluster_summary(spark, sf_dir),
        system_ids=SYSTEM_IDS,
        system_name_words=SYSTEM_NAME_WORDS,
    )


@register
def fleet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry ⟕ status ⟕ summary with fallbacks."""
    return _fleet_report(spark, sf_dir)


@register
def fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet totals."""
    from fleetlens.operators import fleet

    return fleet.fleet_summary(_fleet_report(spark, sf_dir))


@register
def health_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters per health status."""
    from fleetlens.operators import fleet

    return fleet.health_distribution(_fleet_report(spark, sf_dir))


@register
def resolve_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster names (exact, lower-cased, 4-char tails, customer names) -> ids."""
    from fleetlens.operators import fleet

    s = table(spark, sf_dir, "supplier")
    c = table(spark, sf_dir, "customer")
    req = (
        s.select(F.col("s_name").alias("name"))
        .unionByName(s.select(F.lower("s_name").alias("name")))
        .unionByName(s.select(F.expr("right(s_name, 4)").alias("name")))
        .unionByName(c.select(F.col("c_name").alias("name")))
    )
    return fleet.resolve_cluster_names(req, adaptors.registry(spark, sf_dir))


@register
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """include/exclude globs on id or name, system clusters out,
    then the node metrics restricted to the matching clusters by a semi join."""
    reg = adaptors.registry(spark, sf_dir)
    reg = filters.exclude_system_clusters(reg, SYSTEM_IDS, SYSTEM_NAME_WORDS)
    pred = filters.target_predicate(F.col("id"), F.col("name"), ["Supplier#0000000[0-4]*", "*9"], ["*7", "1?"])
    chosen = reg.where(pred)
    lineitems = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("cluster_id"), "l_orderkey", "l_linenumber")
    kept = filters.restrict_to(lineitems, chosen, "cluster_id", "id")
    return kept.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("docs"))


# --- catalog sampling ---------------------------------------------------------


def _eligible(spark: SparkSession, sf_dir: str, max_indices: int) -> DataFrame:
    from fleetlens.operators import catalog

    reg, status = adaptors.catalog_clusters(spark, sf_dir)
    return catalog.eligible_indices(reg, status, adaptors.index_catalog(spark, sf_dir), max_indices=max_indices)


@register
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows as listed, missing names and flags filled."""
    reg = adaptors.registry(spark, sf_dir)
    holes = reg.withColumns({"name": F.when(F.col("id") % 10 != 0, F.col("name")), "enabled": F.when(F.col("id") % 4 != 0, F.col("enabled"))})
    return normalize_registry(holes).select("id", "name", "enabled", "monitored")


@register
def index_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available clusters, eligible indices, cap 3 per cluster."""
    return _eligible(spark, sf_dir, 3)


@register
def index_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two documents of every eligible index (long form)."""
    from fleetlens.operators import catalog

    idx = _eligible(spark, sf_dir, 0)
    return catalog.sample_documents(idx, adaptors.index_documents(spark, sf_dir), sample_size=2)


# --- benchmark runs -----------------------------------------------------------


@register
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and per-side sums over measured rounds."""
    from fleetlens.operators import benchruns

    return benchruns.run_summary(benchruns.measured(adaptors.benchmark_runs(spark, sf_dir)))


@register
def bench_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query name statistics."""
    from fleetlens.operators import benchruns

    return benchruns.per_query_stats(benchruns.measured(adaptors.benchmark_runs(spark, sf_dir)))


@register
def bench_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per measured round and side."""
    from fleetlens.operators import benchruns

    return benchruns.round_series(adaptors.benchmark_runs(spark, sf_dir))


@register
def bench_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original vs optimized per base name."""
    from fleetlens.operators import benchruns

    return benchruns.compare_sides(adaptors.benchmark_runs(spark, sf_dir))


@register
def bench_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query pair x round matrix."""
    from fleetlens.operators import benchruns

    return benchruns.pair_matrix(adaptors.benchmark_runs(spark, sf_dir))


@register
def run_logs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs read from JSON Lines files, as a pair matrix."""
    from fleetlens.operators import benchruns

    return benchruns.pair_matrix(read_runs(spark, adaptors.run_logs(spark, sf_dir)))


# --- search profiles ----------------------------------------------------------


@register
def profile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-profile totals."""
    from fleetlens.operators import profile

    return profile.profile_rollup(adaptors.search_profiles(spark, sf_dir))


@register
def slowest_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slowest shard per profile."""
    from fleetlens.operators import profile

    return profile.slowest_shard(adaptors.search_profiles(spark, sf_dir))


@register
def profile_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three query components per profile."""
    from fleetlens.operators import profile

    return profile.top_query_components(adaptors.search_profiles(spark, sf_dir))


@register
def profile_collectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three collectors per profile."""
    from fleetlens.operators import profile

    return profile.top_collectors(adaptors.search_profiles(spark, sf_dir))


@register
def profile_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakdown phase totals, top three per profile."""
    from fleetlens.operators import profile

    return profile.top_breakdown_phases(adaptors.search_profiles(spark, sf_dir))


@register
def profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile result record per run (order): run fields plus profile totals, flattened."""
    from fleetlens.operators import profile

    runs = adaptors.search_profiles(
        spark,
        sf_dir,
        with_columns=[
            F.concat(F.lit("Q"), F.col("o_orderpriority")).alias("name"),
            F.concat(F.lit("idx-"), F.lower("o_orderstatus"), F.lit("/_search")).alias("path"),
            F.lit("GET").alias("method"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("iteration"),
            F.when(F.col("o_orderstatus") == "F", F.lit("original")).otherwise(F.lit("optimized")).alias("query_type"),
            F.floor(F.col("o_totalprice") / 100).cast("double").alias("duration"),
            F.floor(F.col("o_totalprice") / 1000).cast("double").alias("took"),
        ],
    )
    r = profile.profile_records(runs)
    flat = r.select("name", "path", "method", "iteration", "query_type", "duration_ms", "took_ms", "profile_summary.*")
    return flat.select(
        *flat.columns[:12],
        F.col("slowest_shard.shard_id").alias("slowest_shard_id"),
        F.col("slowest_shard.total_time_ms").alias("slowest_shard_ms"),
        F.array_join(F.transform("top_query_components", lambda x: x["shard"].cast("string")), ",").alias("top_component_shards"),
        F.array_join(F.transform("top_collectors", lambda x: x["shard"].cast("string")), ",").alias("top_collector_shards"),
        F.array_join(F.transform("top_breakdown", lambda x: x["phase"]), ",").alias("top_phases"),
    )


# --- request logs -------------------------------------------------------------


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.operators import requests

    return requests.parse_requests(adaptors.request_files(spark, sf_dir))


@register
def request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split request files into cases, flag bad ones."""
    return _cases(spark, sf_dir)


@register
def request_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request files read by lines, their cases numbered per file."""
    from fleetlens.operators import requests

    cases = requests.read_request_logs(spark, adaptors.request_logs(spark, sf_dir))
    parsed = requests.parse_requests(cases, number_col="number")
    log = F.regexp_extract("file_id", "log=([0-9]+)", 1).cast("bigint")
    return parsed.select(log.alias("log"), "seq", "title", "method", "path", "body_raw", "body_sent", "body_is_ndjson", "body_valid", "error")


@register
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact text of every valid JSON body, written with white space first."""
    from fleetlens.functions import scalars

    good = _cases(spark, sf_dir).where("body_valid and error is null")
    spaced = F.regexp_replace("body_raw", "([:,{}])", "$1 \n")
    return good.select("file_id", "seq", scalars.json_compact(spaced).alias("body"))


@register
def request_bodies_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid JSON body laid out over lines."""
    from fleetlens.functions.jsontext import json_pretty

    good = _cases(spark, sf_dir).where("body_valid and error is null")
    return good.select("file_id", "seq", json_pretty("body_raw").alias("body"))


@register
def request_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index names addressed by each good case."""
    from fleetlens.operators import requests

    return requests.request_targets(_cases(spark, sf_dir))


@register
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets resolved through the alias table, order-preserving dedupe."""
    from fleetlens.operators import requests

    t = requests.request_targets(_cases(spark, sf_dir))
    return requests.resolve_aliases(t, adaptors.index_aliases(spark, sf_dir))


@register
def request_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved indices joined with their overview, defaults '-'."""
    from fleetlens.operators import requests

    t = requests.request_targets(_cases(spark, sf_dir))
    r = requests.resolve_aliases(t, adaptors.index_aliases(spark, sf_dir))
    return requests.index_overview(r, adaptors.index_overview(spark, sf_dir))


@register
def request_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved indices with overview, mapping and settings."""
    from fleetlens.operators import requests

    t = requests.request_targets(_cases(spark, sf_dir))
    r = requests.resolve_aliases(t, adaptors.index_aliases(spark, sf_dir))
    meta = adaptors.alias_index_metadata(spark, sf_dir)
    return requests.index_report(r, adaptors.index_overview(spark, sf_dir), meta, meta)


# --- alerts, diagnostics, responses, settings, scalars -------------------------


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as alert rules."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") > 0).alias("enabled"),
        F.col("c_mktsegment").alias("resource_type"),
    )


@register
def alerts_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of 1995 with their rule, newest first."""
    from fleetlens.operators import alerts

    msgs = alerts.filter_alerts(alert_messages(spark, sf_dir), "alert_messages", "1995-01-01", "1995-12-31")
    j = alerts.messages_with_rules(msgs, alert_rules(spark, sf_dir))
    return alerts.sort_alerts(j, "alert_messages").select("_id", "created", "status", "rule_id", "rule_name", "rule_enabled", "rule_resource_type")


@register
def alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert-history hits read from files, flattened, filtered by
    their own time column and masked."""
    from fleetlens.operators import alerts

    schema = "_id string, _source struct<timestamp timestamp, rule_id long, state string, node string>, sort array<long>"
    hits = read_alerts(spark, adaptors.alert_hits(spark, sf_dir), "alert_history", T.StructType.fromDDL(schema), "json")
    kept = alerts.filter_alerts(hits, "alert_history", "1995-01-01", "1996-6-30")
    return shape.mask_document(kept).select("_id", "timestamp", "rule_id", "state", "node")


@register
def alert_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules; they have no time column, so none is filtered."""
    from fleetlens.operators import alerts

    rules = alert_rules(spark, sf_dir).withColumnRenamed("id", "_id")
    return alerts.sort_alerts(alerts.filter_alerts(rules, "alert_rules", "1995-01-01", "1995-01-02"), "alert_rules")


@register
def diag_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster rules on the fleet report."""
    from fleetlens.operators import diagnostics

    return diagnostics.cluster_flags(_fleet_report(spark, sf_dir))


@register
def diag_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rules on the sampled node series (15-minute buckets); file
    descriptors, swap and breakers are derived from the value and the status."""
    from fleetlens.operators import diagnostics

    m = adaptors.metrics(spark, sf_dir)
    s = sampling.sample_buckets(m, NODE_GROUP, "15m", FULL_RULES)
    s = s.withColumns(
        {
            "heap_pct": F.least(F.col("value"), F.lit(100.0)),
            "fd_open": F.col("value") * 9,
            "fd_max": F.when(F.col("status") != "purchase", F.lit(1000.0)).otherwise(F.lit(0.0)),
            "swap": F.when(F.col("status") == "error", F.col("value")).otherwise(F.lit(0.0)),
            "tripped": F.when(F.col("status") != "signup", F.pmod(F.floor("value"), F.lit(2))),
        }
    )
    return diagnostics.node_flags(
        s,
        NODE_GROUP,
        heap_percent="heap_pct",
        old_gc_rate="ops",
        cpu_percent="heap_pct",
        fd_open="fd_open",
        fd_max="fd_max",
        swap_used="swap",
        breakers_tripped="tripped",
        search_latency="latency_ms",
        persist_col="ops",
        persist_buckets=3,
    )


@register
def diag_relocating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters whose relocating shards do not settle for three days."""
    from fleetlens.operators import diagnostics

    docs = adaptors.cluster_health_docs(spark, sf_dir).withColumn("relocating_shards", F.pmod(F.col("number_of_nodes"), F.lit(4)))
    s = sampling.sample_buckets(docs, ["cluster_id"], "1d", fields=["relocating_shards"])
    return diagnostics.relocating_flags(s, ["cluster_id"], 86_400_000)


# --- reports ------------------------------------------------------------------

REPORT_TIME = "2024-01-31 00:00:00"


@register
def report_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the 18 columns of the cluster report."""
    from fleetlens.operators import reports

    return reports.cluster_rows(_fleet_report(spark, sf_dir), F.lit(REPORT_TIME))


@register
def report_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: every eligible index with its mapping flag and sample count."""
    from fleetlens.operators import catalog, reports

    idx = _eligible(spark, sf_dir, 0)
    samples = catalog.sample_documents(idx, adaptors.index_documents(spark, sf_dir), sample_size=2)
    mapped = catalog.with_mappings(idx, adaptors.index_metadata(spark, sf_dir)).select("cluster_id", "index_name", "doc_count", "mapping")
    return reports.index_rows(mapped, samples)


@register
def report_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per benchmark execution."""
    from fleetlens.operators import reports

    return reports.run_rows(adaptors.benchmark_runs(spark, sf_dir))


@register
def report_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over the measured rounds' totals."""
    from fleetlens.operators import reports

    return reports.run_statistics(adaptors.benchmark_runs(spark, sf_dir))


@register
def report_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, totals and field notes of a run report, flattened."""
    from fleetlens.operators import reports

    r = reports.report_record(adaptors.benchmark_runs(spark, sf_dir), F.lit(REPORT_TIME))
    return r.select("timestamp", "summary.total", "summary.passed", "summary.pass_rate", F.size(F.map_keys("field_descriptions")).alias("notes"))


@register
def report_clusters_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the cluster report written as CSV and read back."""
    rows = report_clusters(spark, sf_dir)
    path = fresh_folder(spark, "clusters-csv")
    writers.write_csv_report(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@register
def report_cluster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling report by cluster as JSON Lines, read back document by
    document."""
    from fleetlens.operators import catalog

    idx = _eligible(spark, sf_dir, 0)
    nested = catalog.index_samples(idx, catalog.sample_documents(idx, adaptors.index_documents(spark, sf_dir), sample_size=2))
    path = fresh_folder(spark, "cluster-samples")
    writers.write_cluster_samples_json(nested, path)
    read = spark.read.schema(nested.schema).json(path)
    return read.select("cluster_id", "cluster_name", "index_name", "doc_count", F.inline("sample_docs"))


@register
def report_index_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details per cluster and index, whose names hold path characters."""
    samples = index_samples(spark, sf_dir)
    odd = samples.withColumn("index_name", F.concat("index_name", F.lit("/a\\b"), F.col("cluster_id")))
    path = fresh_folder(spark, "index-details")
    writers.write_index_details(odd, path)
    return spark.read.schema(odd.schema).json(path)


@register
def report_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run report and its results written side by side; the results
    as read back, each with the report's pass rate."""
    from fleetlens.operators import reports

    runs = adaptors.benchmark_runs(spark, sf_dir)
    rows, record = reports.run_rows(runs), reports.report_record(runs, F.lit(REPORT_TIME))
    path = fresh_folder(spark, "run-report")
    writers.write_report(record, rows, path)
    rate = spark.read.schema(record.schema).json(f"{path}/report").first()["summary"]["pass_rate"]
    return spark.read.schema(rows.schema).json(f"{path}/results").withColumn("pass_rate", F.lit(rate))


@register
def diag_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted share, shard size skew, size and doc-count limits.

    A part is a shard of index (brand, type): size is the price in units of
    64 MiB, documents ``p_size`` million, deleted documents the price x 1000.
    """
    from fleetlens.operators import diagnostics

    p = table(spark, sf_dir, "part")
    shards = p.select(
        F.col("p_brand").alias("cluster_id"),
        F.lower("p_type").alias("index_name"),
        F.col("p_partkey").alias("shard_id"),
        (F.floor("p_retailprice") * F.lit(64 * 1024 * 1024)).cast("bigint").alias("size_in_bytes"),
        (F.col("p_size") * F.lit(1_000_000)).cast("bigint").alias("docs_count"),
        (F.floor("p_retailprice") * F.lit(1000)).cast("bigint").alias("docs_deleted"),
    )
    flagged = diagnostics.shard_flags(shards, ["cluster_id", "index_name"], max_docs=45_000_000)
    return diagnostics.index_flags(flagged, max_deleted_share=0.05)


@register
def took_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Took of a response, the largest sub-response took for multi-search.

    One response per order, built from the row: top-level took is the total
    price / 1000; three sub-responses carry price / 100, customer key / 10
    (as text, so ignored, on finished orders) and the priority digit.
    ``P`` orders are multi-search requests.
    """
    from fleetlens.operators import benchruns

    o = table(spark, sf_dir, "orders")
    n = lambda c: F.floor(c).cast("string")
    text_took = F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM")
    cust = F.when(text_took, F.concat(F.lit('"'), n(F.col("o_custkey") / 10), F.lit('"'))).otherwise(
        n(F.col("o_custkey") / 10)
    )
    body = F.concat(
        F.lit('{"took":'), n(F.col("o_totalprice") / 1000),
        F.lit(',"responses":[{"took":'), n(F.col("o_totalprice") / 100),
        F.lit('},{"took":'), cust,
        F.lit('},{"took":'), F.substring("o_orderpriority", 1, 1), F.lit("}]}"),
    )
    path = F.when(F.col("o_orderstatus") == "P", F.lit("logs-*/_msearch")).otherwise(F.lit("logs-*/_search"))
    r = adaptors.materialized(o.select(F.col("o_orderkey").alias("response_id"), path.alias("path"), F.try_parse_json(body).alias("body")))
    return r.select("response_id", "path", benchruns.took_from_response(F.col("path"), F.col("body")).alias("took"))


@register
def flatten_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form JSON settings flattened to dotted keys with a prefix."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id"), F.col("props"))
    return shape.flatten_json(ev, ["event_id"], "props", prefix="index")


@register
def format_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte sizes, durations, counts, paths and labels."""
    from fleetlens.functions import scalars

    o = table(spark, sf_dir, "orders")
    size = F.floor(F.col("o_totalprice") * F.col("o_totalprice") * 1000).cast("bigint")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1992-01-01 00:00:00', o_orderdate)") + F.col("o_orderkey") * 1000
    path = F.concat(F.lit("/"), F.lower("o_orderpriority"), F.lit(","), F.lower("o_orderstatus"), F.lit("/_search?q="), F.col("o_custkey").cast("string"))
    name = F.concat(F.col("o_orderpriority"), F.lit(" (original)"))
    return o.select(
        "o_orderkey",
        scalars.format_bytes(F.when(F.col("o_orderstatus") == "F", -size).otherwise(size)).alias("bytes_text"),
        scalars.format_duration(ms).alias("duration_text"),
        scalars.format_count(F.col("o_custkey").cast("string")).alias("count_text"),
        scalars.format_count(F.col("o_orderpriority")).alias("priority_text"),
        F.array_join(scalars.target_names(path), "|").alias("targets"),
        scalars.is_search_path(path).alias("is_search"),
        scalars.is_msearch_path(path).alias("is_msearch"),
        scalars.strip_label(name, ["original", "optimized"]).alias("base_name"),
    )


# --- catalog metadata and cluster status --------------------------------------


@register
def index_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings responses unwrapped to ``settings.index`` and flattened with prefix ``index``."""
    from fleetlens.operators import catalog

    meta = adaptors.index_metadata(spark, sf_dir)
    return shape.flatten_variant(meta, ["cluster_id", "index_name"], catalog.unwrap_settings(meta), prefix="index")


@register
def index_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible indices with their unwrapped mapping."""
    from fleetlens.operators import catalog

    idx = _eligible(spark, sf_dir, 0)
    return catalog.with_mappings(idx, adaptors.index_metadata(spark, sf_dir)).select(
        "cluster_id", "index_name", "doc_count", "has_mapping", "mapping"
    )


@register
def cluster_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest health document per cluster."""
    from fleetlens.operators import fleet

    docs = adaptors.cluster_health_docs(spark, sf_dir)
    return fleet.latest_cluster_status(docs)
