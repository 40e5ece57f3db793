"""Alerts (F4, O2, J10), diagnostics (D1-D10), approximate estimate (A16),
job split / compression / row cap (K7, O5)."""

import glob
from datetime import datetime, timezone

from pyspark.sql import functions as F

from fleetlens.operators import alerts, diagnostics
from fleetlens.operators.estimate import estimate_sample_size
from fleetlens.plans.job import ExportJob, run_export_job
from fleetlens.sources import adaptors


def test_alert_filters_and_order(spark):
    msgs = spark.createDataFrame(
        [(3, 1, "2026-04-03 10:00:00"), (1, 1, "2026-04-03 10:00:00"), (2, 9, "2026-04-02 00:00:00"), (4, 1, "2026-04-04 00:00:01")],
        "_id int, rule_id int, created string",
    ).withColumn("created", F.to_timestamp("created"))
    rules = spark.createDataFrame([(1, "cpu", True, "cluster")], "id int, name string, enabled boolean, resource_type string")
    kept = alerts.filter_alerts(msgs, "alert_messages", "2026-04-02", "2026-04-03")
    ordered = alerts.sort_alerts(alerts.messages_with_rules(kept, rules), "alert_messages")
    assert [(r["_id"], r["rule_name"]) for r in ordered.collect()] == [(1, "cpu"), (3, "cpu"), (2, None)]
    assert alerts.filter_alerts(msgs, "alert_rules").count() == 4  # rules are not time-filtered


def test_node_and_shard_flags(spark):
    s = spark.createDataFrame(
        [("n", 1, 70.0, 0.1, 80.0, 10, 100, 0, 0, 120.0), ("n", 2, 80.0, 0.0, 10.0, 90, 100, 1, 2, 50.0), ("n", 3, 90.0, 0.5, 10.0, 0, 0, None, 0, None)],
        "node string, bucket_ms long, heap double, gc double, cpu double, fd long, fdmax long, swap long, trips long, lat double",
    )
    out = diagnostics.node_flags(s, ["node"], heap_percent="heap", old_gc_rate="gc", cpu_percent="cpu", fd_open="fd", fd_max="fdmax",
                                 swap_used="swap", breakers_tripped="trips", search_latency="lat", persist_col="gc", persist_buckets=2)
    r = {x["bucket_ms"]: x for x in out.collect()}
    assert [r[i]["heap_level"] for i in (1, 2, 3)] == ["ok", "warning", "critical"]
    assert r[1]["old_gc_frequent"] is True and r[2]["old_gc_frequent"] is False
    assert r[1]["cpu_high"] is True and r[2]["fd_high"] is True and r[3]["fd_high"] is None
    assert r[2]["swap_used"] is True and r[2]["breaker_tripped"] is True and r[1]["search_slow"] is True
    assert r[1]["persistent"] is False and r[2]["persistent"] is False and r[3]["persistent"] is False
    sh = spark.createDataFrame([("i", 10 * 1024**3, 1), ("i", 60 * 1024**3, 300_000_000)], "index string, size_in_bytes long, docs_count long")
    f = {x["size_in_bytes"]: x for x in diagnostics.shard_flags(sh, ["index"]).collect()}
    assert f[60 * 1024**3]["too_large"] is True and f[60 * 1024**3]["too_many_docs"] is True
    assert abs(f[10 * 1024**3]["size_skew"] - 60 / 35) < 1e-3


def test_approximate_estimate(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("g"), F.lit(datetime(2024, 1, 1)).alias("timestamp"))
    lo, hi = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2024, 1, 1, 23, 59, 59, tzinfo=timezone.utc)
    exact = estimate_sample_size(df, ["g"], "1h", lo, hi).first()
    approx = estimate_sample_size(df, ["g"], "1h", lo, hi, exact=False).first()
    assert exact["groups"] == 50 and abs(approx["groups"] - 50) <= 2 and exact["buckets"] == 24


def test_job_split_compress_cap(spark, tmp_dir):
    docs = adaptors.metric_documents(spark, "/root/testdata/sf0.001").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    docs.write.mode("overwrite").parquet(f"{tmp_dir}/store")
    job = ExportJob(name="split", output_path=f"{tmp_dir}/out", metrics_path=f"{tmp_dir}/store", metric_types=["node_stats"],
                    start="2024-01-01", end="2024-01-30", split_by="cluster", compression="gzip", max_docs=25)
    row = run_export_job(spark, job).first()
    assert row["rows"] == 25 and row["error"] is None
    assert glob.glob(f"{tmp_dir}/out/node_stats/cluster=*/part-*.json.gz")
    back = spark.read.json(f"{tmp_dir}/out/node_stats")
    newest = docs.orderBy(F.col("timestamp").desc(), F.col("_id").asc()).limit(25).select("_id").collect()
    assert sorted(r["_id"] for r in back.select("_id").collect()) == sorted(r["_id"] for r in newest)
