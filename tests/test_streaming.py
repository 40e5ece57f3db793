"""The streaming sampler agrees with the batch sampler on every emitted bucket."""

from pyspark.sql import functions as F

from fleetlens.operators.sampling import FieldRules, sample_buckets
from fleetlens.sources import adaptors
from fleetlens.streaming.sampler import start_sampler, stream_rates


def test_rates_quotients_and_expiry(spark, tmp_dir):
    """Micro-batches in any cut equal the batch sampler; old groups leave the state."""
    hour, start = 3_600_000, 1_704_067_200_000
    rules = FieldRules(rate=("ops",), latency={"lat": ("tm", "ops")}, ratio={"per": ("ops", "tm")})
    rows = []
    for g in range(6):
        for b in range(40):
            if (b * 7 + g) % 5:
                rows.append((f"g{g}", start + b * hour, None if (b + g) % 4 == 0 else (b * 13 + g) % 50, None if (b + g) % 3 == 0 else (b * 29) % 70))
    rows = [r for r in rows if r[0] != "g5" or r[1] < start + 3 * hour]  # one group ends early
    schema = "g string, bucket_ms long, ops long, tm long"
    cuts = [0, 2, 3, 11, 12, 30, 40]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_dir}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in")
    out = stream_rates(src, ["g"], ("ops",), "1h", quotients={"lat": ("tm", "ops"), "per": ("ops", "tm")}, ttl="10h")
    q = out.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_dir}/ck").format("memory").queryName("rates_and_quotients").start()
    try:
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = spark.createDataFrame([r for r in rows if low * hour <= r[1] - start < high * hour], schema)
            part.coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
            q.processAllAvailable()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    docs = spark.createDataFrame([(f"{g}{b}", b, g, o, t) for g, b, o, t in rows], "_id string, b long, g string, ops long, tm long").withColumn("timestamp", F.timestamp_millis("b"))
    want = {(r["g"], r["bucket_ms"]): (r["ops"], r["lat"], r["per"]) for r in sample_buckets(docs, ["g"], "1h", rules).collect()}
    got = {(r["g"], r["bucket_ms"]): (r["ops"], r["lat"], r["per"]) for r in spark.sql("select * from rates_and_quotients").collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        for x, y in zip(got[k], values, strict=True):
            assert (x is None and y is None) or abs(x - y) < 1e-12
    assert max(states) == 6 and states[-1] == 5


def test_stream_matches_batch(spark, tmp_dir):
    m = adaptors.metrics(spark, "/root/testdata/sf0.001").select(
        "_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "cluster_id", "node_id", "value", "ops"
    )
    m.write.mode("overwrite").parquet(f"{tmp_dir}/in")
    src = spark.readStream.schema(m.schema).parquet(f"{tmp_dir}/in")
    q1, q2 = start_sampler(
        src, ["cluster_id", "node_id"], "1h", "1 hour", ("ops",), f"{tmp_dir}/buckets", f"{tmp_dir}/ck",
        lambda w: w.format("memory").queryName("stream_rates_test").start(), max_fields=("value",),
    )
    try:
        q1.processAllAvailable()
        q2.processAllAvailable()
    finally:
        q1.stop()
        q2.stop()
    streamed = {(r["cluster_id"], r["node_id"], r["bucket_ms"]): r["ops"] for r in spark.sql("select * from stream_rates_test").collect()}
    batch = sample_buckets(m, ["cluster_id", "node_id"], "1h", FieldRules(rate=("ops",)))
    expected = {(r["cluster_id"], r["node_id"], r["bucket_ms"]): r["ops"] for r in batch.collect()}
    assert streamed
    for k, v in streamed.items():
        assert (v is None and expected[k] is None) or abs(v - expected[k]) < 1e-12
