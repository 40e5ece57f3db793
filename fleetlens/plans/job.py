"""Export job (X1): targets -> filter -> sample or full -> mask -> slim ->
project -> write, per metric type and per alert type, with a summary.

Each type is a lazy DataFrame and a write; its row count is taken with
``observe`` during that write, so nothing is scanned twice.  Writes go
straight from the executors to the output folder.  ``parallel`` types run at a
time, each in a scheduler pool and under a tag of its own, so that one slow
type does not hold the others and one type can be cancelled.

With ``slice_interval`` a full export is cut into time slices, each written to
a folder of its own and then entered in the manifest, a small table beside the
output: job settings, slice, cursor, rows and files.  A job that is started
again leaves out the slices that are entered under the same settings; a slice
that was being written is written anew into the same folder, so nothing comes
twice.  A sampled export is one slice, because its counters carry over time.
"""

from __future__ import annotations

import hashlib
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields
from datetime import datetime, timedelta, timezone

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.fieldspec import METRIC_TYPES, classify_fields, document_schema, envelope_schema
from fleetlens.functions.nested import field_type, quote_path
from fleetlens.functions.timeutil import parse_interval_ms, resolve_time_window
from fleetlens.operators import filters, sampling, shape
from fleetlens.operators.fleet import active_clusters
from fleetlens.session import materialized, write_shared
from fleetlens.sinks.writers import DEFAULT_ROWS_PER_FILE, planned_files, write_json_lines, write_text_lines
from fleetlens.sources.restfields import REST, read_with_rest, whole_document
from fleetlens.sources.tables import ALERT_TIME_COLUMNS, read_alerts, read_metrics

SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("started", T.TimestampType()),
        T.StructField("slices", T.IntegerType()),
        T.StructField("slices_done_before", T.IntegerType()),
    ]
)

# One row per written slice; ``low`` is its first instant, ``high`` the first
# one after it, ``last_time`` the newest document's time.
MANIFEST_SCHEMA = "settings string, kind string, type string, low timestamp, high timestamp, last_time timestamp, rows long, files long, path string"


@dataclass
class ExportJob:
    """What to export and how.  ``metric_types=None`` means all five types,
    an empty list means none (the same for ``alert_types``)."""

    name: str
    output_path: str
    metrics_path: str | None = None
    metrics_format: str = "parquet"
    metric_types: list[str] | None = None
    alert_paths: dict[str, str] = field(default_factory=dict)
    alerts_format: str = "parquet"
    alert_types: list[str] | None = None
    start: str | None = None
    end: str | None = None
    hours: int = 1
    now: datetime | None = None
    include_clusters: list[str] | None = None
    exclude_clusters: list[str] | None = None
    include_nodes: list[str] | None = None
    exclude_nodes: list[str] | None = None
    include_indices: list[str] | None = None
    exclude_indices: list[str] | None = None
    sampling_interval: str | None = None
    rules: dict[str, sampling.FieldRules] | None = None
    # JSON is read with the declared schema of its type, never inferred; fields
    # outside it are read only if a schema given here holds them
    schemas: dict[str, T.StructType] | None = None
    fallback: str = "latest"
    source_fields: list[str] | None = None
    mask: bool = False
    slim: shape.SlimConfig = field(default_factory=shape.SlimConfig)
    rows_per_file: int = DEFAULT_ROWS_PER_FILE
    split_by: str | None = None  # None, "cluster" or "type"
    compression: str | None = None
    max_docs: int | None = None
    # whole files per cluster: rows are numbered and dealt out before a split write
    full_files: bool = False
    # JSON input: fields outside the declared schema are kept and written again
    keep_rest: bool = False
    # buckets of one series that are finished in one task (None: all of them)
    carry_block: int | None = None
    parallel: int = 2
    slice_interval: str | None = None


LABEL = "metadata.labels"


def time_bounds(job: ExportJob) -> tuple[datetime, datetime]:
    return resolve_time_window(job.hours, job.start, job.end, job.now)


def _read(spark: SparkSession, job: ExportJob, metric_type: str | None) -> DataFrame:
    """Documents of a type (None: of all types, envelope only) in the window."""
    schema = None
    if metric_type:
        schema = (job.schemas or {}).get(metric_type) or (document_schema(metric_type) if job.metrics_format == "json" else None)
    elif job.metrics_format == "json":
        schema = envelope_schema()
    if metric_type and _keeps_rest(job):
        df = read_with_rest(spark, job.metrics_path, schema).where(F.col("metadata.name") == metric_type)
    else:
        df = read_metrics(spark, job.metrics_path, metric_type, schema, job.metrics_format)
    return filters.time_window(df, "timestamp", *time_bounds(job))


def _keeps_rest(job: ExportJob) -> bool:
    return job.keep_rest and job.metrics_format == "json"


def matching_clusters(spark: SparkSession, job: ExportJob) -> DataFrame | None:
    """Ids of the clusters that the job's globs let in (F6, F7), once per job.

    The cluster list is that of the window over all types (A19: each cluster
    with its most frequent name); globs match id or name.  None: no globs."""
    if not (job.include_clusters or job.exclude_clusters) or not job.metrics_path:
        return None
    df = _read(spark, job, None)
    cid = F.col(f"{LABEL}.cluster_id")
    cname = F.col(f"{LABEL}.cluster_name") if field_type(df.schema, f"{LABEL}.cluster_name") else cid
    clusters = active_clusters(df.select(cid.alias("cluster_id"), cname.alias("cluster_name")))
    chosen = clusters.where(filters.target_predicate(F.col("cluster_id"), F.col("cluster_name"), job.include_clusters, job.exclude_clusters))
    return write_shared(chosen.select("cluster_id"), "clusters")


def _target_filter(df: DataFrame, job: ExportJob, clusters: DataFrame | None) -> DataFrame:
    """Matching clusters by a semi join, node and index globs (F8)."""
    out = df if clusters is None else filters.restrict_to(df, clusters, f"{LABEL}.cluster_id", "cluster_id")
    for col, inc, exc in (
        (f"{LABEL}.node_name", job.include_nodes, job.exclude_nodes),
        (f"{LABEL}.index_name", job.include_indices, job.exclude_indices),
    ):
        if (inc or exc) and field_type(out.schema, col) is not None:
            out = out.where(filters.target_predicate(F.col(quote_path(col)), F.col(quote_path(col)), inc, exc))
    return out


def metric_documents(spark: SparkSession, job: ExportJob, metric_type: str, clusters: DataFrame | None = None) -> DataFrame:
    """The filtered, sampled and limited documents of one type, not yet shaped."""
    spec = METRIC_TYPES[metric_type]
    df = _target_filter(_read(spark, job, metric_type), job, clusters)
    if job.sampling_interval:
        groups = sampling.resolve_group_columns(df, list(spec.group_fields), fixed=spec.fixed_groups)
        rules = (job.rules or {}).get(metric_type) or classify_fields(df.schema, metric_type)
        wanted = [*job.source_fields, *([REST] if _keeps_rest(job) else [])] if job.source_fields else None
        df = sampling.sample_buckets(df, groups, job.sampling_interval, rules, fallback=job.fallback, fields=wanted, carry_block=job.carry_block).drop("bucket_ms")
    return newest(df, "timestamp", job.max_docs) if job.max_docs else df


def newest(df: DataFrame, ts_col: str | None, limit: int) -> DataFrame:
    """The ``limit`` newest documents, ties by id."""
    keys = [F.col(ts_col).desc_nulls_last()] if ts_col and field_type(df.schema, ts_col) is not None else []
    return df.orderBy(*keys, *([F.col("_id").asc()] if "_id" in df.columns else [])).limit(limit)


def _shaped(df: DataFrame, job: ExportJob) -> DataFrame:
    if REST in df.columns:
        document = shape.shape_variant_text(F.col("__doc"), job.source_fields, mask=job.mask, slim=job.slim)
        return materialized(df.select(whole_document(df).alias("__doc"))).select(document.alias("value"))
    return shape.shape_documents(df, job.source_fields, mask=job.mask, slim=job.slim)


def alert_documents(spark: SparkSession, job: ExportJob, alert_type: str) -> DataFrame:
    df = read_alerts(spark, job.alert_paths[alert_type], alert_type, fmt=job.alerts_format)
    col = ALERT_TIME_COLUMNS[alert_type]
    if col is not None and col in df.columns:
        df = filters.time_window(df, col, *time_bounds(job))
    return newest(df, col, job.max_docs) if job.max_docs else df


def _write(df: DataFrame, path: str, job: ExportJob, kind: str, ts_col: str | None) -> tuple[int, datetime | None]:
    """Shape and write documents; their number and newest time, as observed."""
    obs = Observation(f"{kind}-rows")
    split, dealt = None, df
    if job.split_by == "cluster" and field_type(df.schema, f"{LABEL}.cluster_id") is not None:
        split = ["cluster"]
        dealt = df.withColumn("cluster", F.col(f"{LABEL}.cluster_id"))
        if job.full_files and job.rows_per_file and "_id" in df.columns:
            dealt = planned_files(dealt, split, job.rows_per_file, ["_id"])
    last = F.max(F.col(ts_col).cast("timestamp")) if ts_col and field_type(df.schema, ts_col) is not None else F.lit(None).cast("timestamp")
    observed = dealt.observe(obs, F.count(F.lit(1)).alias("rows"), last.alias("last_time"))
    rest = REST in df.columns
    if kind == "alert":
        out = shape.shape_documents(observed, None, mask=job.mask, slim=None)
    elif split and rest:
        packed = materialized(observed.select("cluster", whole_document(observed.drop("cluster")).alias("__doc")))
        out = packed.select("cluster", shape.shape_variant_text(F.col("__doc"), job.source_fields, mask=job.mask, slim=job.slim).alias("value"))
    elif split:
        out = shape.shape_documents(observed, [*job.source_fields, "cluster"] if job.source_fields else None, mask=job.mask, slim=job.slim)
    else:
        out = _shaped(observed, job)
    (write_text_lines if rest else write_json_lines)(out, path, job.rows_per_file, split, job.compression)
    return int(obs.get.get("rows", 0)), obs.get.get("last_time")


def settings_of(job: ExportJob) -> str:
    """A digest of everything that decides what a slice holds."""
    free = {"name", "now", "hours", "start", "end", "parallel", "output_path"}  # the slice's own bounds are kept with it
    text = "\n".join(f"{f.name}={getattr(job, f.name)!r}" for f in fields(job) if f.name not in free)
    return hashlib.sha256(text.encode()).hexdigest()


def slices(job: ExportJob, timed: bool) -> list[tuple[datetime, datetime]]:
    """The job's window (inclusive) cut at multiples of the slice interval, as
    (first instant, first instant after it)."""
    low, last = time_bounds(job)
    high = last + timedelta(microseconds=1)
    if not (job.slice_interval and timed) or job.sampling_interval or job.max_docs:
        return [(low, high)]
    step = parse_interval_ms(job.slice_interval)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    first = (low - epoch) // timedelta(milliseconds=step)
    edges, at = [low], first + 1
    while (edge := epoch + at * timedelta(milliseconds=step)) < high:
        edges.append(edge)
        at += 1
    return list(zip(edges, [*edges[1:], high], strict=True))


def manifest(spark: SparkSession, output_path: str) -> DataFrame:
    """The slices written so far; empty before the first one."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{output_path}/_manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def _enter(spark: SparkSession, job: ExportJob, row: tuple) -> None:
    spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{job.output_path}/_manifest")


def job_tag(job: ExportJob, name: str) -> str:
    """The tag of one type's Spark jobs; cancel it to stop that type alone."""
    return f"export-{job.name}-{name}".replace(",", "_")


def _export_type(spark: SparkSession, job: ExportJob, kind: str, name: str, clusters: DataFrame | None, done: dict) -> tuple:
    started, clock = datetime.now(timezone.utc), time.time()
    context = spark.sparkContext
    context.setLocalProperty("spark.scheduler.pool", name)
    context.addJobTag(job_tag(job, name))
    target = f"{job.output_path}/{name}" if job.split_by != "type" else f"{job.output_path}/type={name}"
    ts_col = "timestamp" if kind == "metric" else ALERT_TIME_COLUMNS[name]
    parts = slices(job, ts_col is not None)
    rows, skipped, error = 0, 0, None
    try:
        frame = None
        for low, high in parts:
            at = target if len(parts) == 1 and not job.slice_interval else f"{target}/slice={low:%Y%m%dT%H%M%S}"
            entry = (kind, name, low, high)
            if job.slice_interval and entry in done:
                rows, skipped = rows + done[entry], skipped + 1
                continue
            if frame is None:
                frame = metric_documents(spark, job, name, clusters) if kind == "metric" else alert_documents(spark, job, name)
            part = frame if len(parts) == 1 else filters.time_window(frame, ts_col, low, high - timedelta(microseconds=1))
            count, last = _write(part, at, job, kind, ts_col)
            rows += count
            if job.slice_interval:
                files = len(spark.read.text(at, recursiveFileLookup=True).inputFiles())
                _enter(spark, job, (settings_of(job), kind, name, low, high, last, count, files, at))
    except Exception as exc:  # noqa: BLE001 - the summary reports per-type failures
        error = f"{type(exc).__name__}: {exc}"
    finally:
        context.removeJobTag(job_tag(job, name))
        context.setLocalProperty("spark.scheduler.pool", None)
    return (job.name, kind, name, 0 if error else rows, time.time() - clock, error, target, started, len(parts), skipped)


def run_export_job(spark: SparkSession, job: ExportJob) -> DataFrame:
    """Run the export; returns the per-type summary (K5) as a DataFrame, in the
    order of the types."""
    metric_types = list(METRIC_TYPES) if job.metric_types is None else list(job.metric_types)
    alert_types = list(job.alert_paths) if job.alert_types is None else list(job.alert_types)
    work = [("metric", t) for t in metric_types if job.metrics_path] + [("alert", t) for t in alert_types if t in job.alert_paths]
    clusters = matching_clusters(spark, job) if any(kind == "metric" for kind, _ in work) else None
    done = {}
    if job.slice_interval:
        entered = manifest(spark, job.output_path).where(F.col("settings") == settings_of(job))
        done = {(r["kind"], r["type"], _utc(r["low"]), _utc(r["high"])): r["rows"] for r in entered.collect()}  # a row per slice
    with ThreadPoolExecutor(max_workers=max(1, job.parallel)) as pool:
        # each thread inherits the caller's properties and session
        jobs = [pool.submit(inheritable_thread_target(spark)(_export_type), spark, job, kind, name, clusters, done) for kind, name in work]
        rows = [j.result() for j in jobs]
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)


def _utc(instant: datetime) -> datetime:
    return instant.astimezone(timezone.utc)


def summary_totals(summary: DataFrame) -> DataFrame:
    """Totals over the summary (K6)."""
    return summary.agg(
        F.sum("rows").alias("rows"),
        F.sum("seconds").alias("seconds"),
        F.count_if(F.col("error").isNotNull()).alias("failed_types"),
    )
