"""Export job and sinks."""

import glob
import os

from pyspark.sql import functions as F

from fleetlens.functions.fieldspec import classify_fields
from fleetlens.operators.shape import SlimConfig
from fleetlens.plans.job import ExportJob, run_export_job, summary_totals
from fleetlens.sinks.writers import file_row_counts, write_json_lines
from fleetlens.sources import adaptors

SF = "/root/testdata/sf0.001"


def test_rows_per_file_cap(spark, tmp_dir):
    df = spark.range(5).coalesce(1)
    write_json_lines(df, f"{tmp_dir}/out", rows_per_file=2)
    counts = sorted(r["rows"] for r in file_row_counts(spark, f"{tmp_dir}/out").collect())
    assert counts == [1, 2, 2]
    empty = spark.range(0).coalesce(1)
    write_json_lines(empty, f"{tmp_dir}/empty")
    assert glob.glob(f"{tmp_dir}/empty/part-*")


def store(spark, tmp_dir):
    docs = adaptors.metric_documents(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = f"{tmp_dir}/store"
    docs.write.mode("overwrite").parquet(path)
    return path, docs.count()


def test_classification_rule(spark):
    docs = adaptors.metric_documents(spark, SF)
    rules = classify_fields(docs.schema, "node_stats")
    root = "payload.elasticsearch.node_stats"
    assert f"{root}.indices.search.query_total" in rules.rate
    assert f"{root}.indices.search.query_time_in_millis" in rules.rate
    assert rules.latency[f"{root}.indices.search.query_latency"] == (
        f"{root}.indices.search.query_time_in_millis", f"{root}.indices.search.query_total")
    assert f"{root}.jvm.mem.heap_used_in_bytes" in rules.max
    assert f"{root}.indices.store.size_in_bytes" not in rules.rate


def test_export_full_and_sampled(spark, tmp_dir):
    path, total = store(spark, tmp_dir)
    full = ExportJob(name="full", output_path=f"{tmp_dir}/full", metrics_path=path, metric_types=["node_stats"],
                     start="2024-01-01", end="2024-01-30", mask=True, slim=SlimConfig(enabled=True), rows_per_file=100)
    s = run_export_job(spark, full).collect()
    assert s[0]["rows"] == total and s[0]["error"] is None
    back = spark.read.json(f"{tmp_dir}/full/node_stats")
    assert "_id" not in back.columns and "agent" not in back.columns
    assert back.where(F.col("metadata.labels.transport_address").rlike(r"^\*\.\*\.")).count() == total
    assert max(r["rows"] for r in file_row_counts(spark, f"{tmp_dir}/full/node_stats").collect()) <= 100

    sampled = ExportJob(name="s", output_path=f"{tmp_dir}/s", metrics_path=path, metric_types=["node_stats"],
                        start="2024-01-01", end="2024-01-30", sampling_interval="1d", include_clusters=["[0-3]"])
    s = run_export_job(spark, sampled)
    row = s.collect()[0]
    assert 0 < row["rows"] < total and row["error"] is None
    out = spark.read.json(f"{tmp_dir}/s/node_stats")
    assert {r["c"] for r in out.select(F.col("metadata.labels.cluster_id").alias("c")).distinct().collect()} <= {"0", "1", "2", "3"}
    assert summary_totals(s).first()["failed_types"] == 0

    none = ExportJob(name="n", output_path=f"{tmp_dir}/n", metrics_path=path, metric_types=[])
    assert run_export_job(spark, none).count() == 0
    nomatch = ExportJob(name="m", output_path=f"{tmp_dir}/m", metrics_path=path, metric_types=["node_stats"],
                        start="2024-01-01", end="2024-01-30", include_clusters=["nothing-*"])
    assert run_export_job(spark, nomatch).first()["rows"] == 0
    assert os.path.isdir(f"{tmp_dir}/m/node_stats")


def test_export_alerts(spark, tmp_dir):
    msgs = spark.createDataFrame(
        [("m1", "r1", "2024-01-02 00:00:00", "10.1.2.3 down"), ("m2", "r1", "2024-03-01 00:00:00", "late")],
        "_id string, rule_id string, created string, message string",
    ).withColumn("created", F.to_timestamp("created"))
    rules = spark.createDataFrame([("r1", "cpu", True)], "_id string, name string, enabled boolean")
    msgs.write.mode("overwrite").parquet(f"{tmp_dir}/msgs")
    rules.write.mode("overwrite").parquet(f"{tmp_dir}/rules")
    job = ExportJob(name="alerts", output_path=f"{tmp_dir}/alerts_out", metric_types=[], mask=True,
                    alert_paths={"alert_messages": f"{tmp_dir}/msgs", "alert_rules": f"{tmp_dir}/rules"},
                    start="2024-01-01", end="2024-01-31")
    s = {r["type"]: r for r in run_export_job(spark, job).collect()}
    assert s["alert_messages"]["rows"] == 1 and s["alert_rules"]["rows"] == 1
    back = spark.read.json(f"{tmp_dir}/alerts_out/alert_messages").first()
    assert back["_id"] == "m1" and back["message"] == "*.*.2.3 down"
