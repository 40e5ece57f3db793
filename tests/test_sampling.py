"""Sampler cases from the reference's aggregator tests (FIXTURES §2.1, §2.2) and properties."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetlens.operators.estimate import estimate_sample_size
from fleetlens.operators.sampling import FieldRules, latest_per_bucket, resolve_group_columns, sample_buckets

T0 = datetime(2024, 4, 2, 0, 0, 0)
SCHEMA = "_id string, timestamp timestamp, node string, index_total long, time_ms long, count long, heap double, note string"


def frame(spark, rows):
    return spark.createDataFrame([Row(**r) for r in rows], SCHEMA)


def doc(i, minutes, node="n1", index_total=None, time_ms=None, count=None, heap=None, note=None):
    return dict(_id=str(i), timestamp=T0 + timedelta(minutes=minutes), node=node, index_total=index_total,
                time_ms=time_ms, count=count, heap=heap, note=note)


def run(spark, rows, rules, interval="15m"):
    out = sample_buckets(frame(spark, rows), ["node"], interval, rules)
    return [r.asDict() for r in out.orderBy("node", "bucket_ms").collect()]


def test_rate_first_raw_then_delta(spark):
    rows = run(spark, [doc(1, 0, index_total=1000), doc(2, 15, index_total=2000)], FieldRules(rate=("index_total",)))
    assert rows[0]["index_total"] == 1000.0
    assert rows[1]["index_total"] == pytest.approx(1000 / 900)


def test_rate_three_buckets(spark):
    rows = run(spark, [doc(1, 0, index_total=1000), doc(2, 15, index_total=2000), doc(3, 30, index_total=3500)],
               FieldRules(rate=("index_total",)))
    assert [r["index_total"] for r in rows] == pytest.approx([1000.0, 1000 / 900, 1500 / 900])


def test_counter_reset(spark):
    rows = run(spark, [doc(1, 0, index_total=10000), doc(2, 15, index_total=500)], FieldRules(rate=("index_total",)))
    assert rows[1]["index_total"] == pytest.approx(500 / 900)


def test_two_groups_interleaved(spark):
    data = [doc(1, 0, "n1", 1000), doc(2, 1, "n2", 5000), doc(3, 15, "n1", 2000), doc(4, 16, "n2", 7000)]
    rows = run(spark, data, FieldRules(rate=("index_total",)))
    by = {(r["node"], r["bucket_ms"]): r["index_total"] for r in rows}
    second = int((T0 + timedelta(minutes=15)).timestamp() * 1000)
    assert by[("n1", second)] == pytest.approx(1000 / 900)
    assert by[("n2", second)] == pytest.approx(2000 / 900)


def test_latency_first_keeps_snapshot_then_ratio(spark):
    rules = FieldRules(latency={"latency": ("time_ms", "count")})
    rows = run(spark, [doc(1, 0, time_ms=5000, count=1000), doc(2, 15, time_ms=12000, count=2000)], rules)
    assert rows[0]["latency"] is None
    assert rows[1]["latency"] == pytest.approx(7.0)


def test_latency_no_new_calls_is_zero(spark):
    rules = FieldRules(latency={"latency": ("time_ms", "count")})
    rows = run(spark, [doc(1, 0, time_ms=5000, count=1000), doc(2, 15, time_ms=6000, count=1000)], rules)
    assert rows[1]["latency"] == 0.0


def test_paired_rate_is_not_zero(spark):
    """Deliberate difference: the documented formula for every rate field."""
    rules = FieldRules(rate=("count",), latency={"latency": ("time_ms", "count")})
    rows = run(spark, [doc(1, 0, time_ms=5000, count=1000), doc(2, 15, time_ms=12000, count=2000)], rules)
    assert rows[1]["count"] == pytest.approx(1000 / 900)


def test_max_in_bucket_and_missing(spark):
    rules = FieldRules(max=("heap",))
    rows = run(spark, [doc(1, 0, heap=2e9), doc(2, 5, heap=1e9), doc(3, 15, heap=None)], rules)
    assert rows[0]["heap"] == 2e9  # newest snapshot has 1e9, bucket max 2e9
    assert rows[1]["heap"] is None


def test_unclassified_keeps_latest(spark):
    rows = run(spark, [doc(1, 0, note="old"), doc(2, 5, note="custom_value")], FieldRules())
    assert rows[0]["note"] == "custom_value"


def test_null_gap_keeps_state(spark):
    data = [doc(1, 0, index_total=1000), doc(2, 15, index_total=2000), doc(3, 30), doc(4, 45, index_total=500)]
    rows = run(spark, data, FieldRules(rate=("index_total",)))
    got = [r["index_total"] for r in rows]
    assert got[0] == 1000.0 and got[1] == pytest.approx(1000 / 900) and got[2] is None
    assert got[3] == pytest.approx(500 / 900)


def test_gap_of_buckets_divides_by_one_interval(spark):
    rows = run(spark, [doc(1, 0, index_total=1000), doc(2, 45, index_total=2800)], FieldRules(rate=("index_total",)))
    assert rows[1]["index_total"] == pytest.approx(2.0)


def test_latest_tie_takes_larger_id(spark):
    data = [doc("b", 3, note="b"), doc("c", 3, note="c")]
    rows = run(spark, data, FieldRules())
    assert rows[0]["_id"] == "c"
    w = latest_per_bucket(frame(spark, data), ["node"], "15m").collect()
    assert w[0]["_id"] == "c"


def test_null_group_rows_are_not_sampled(spark):
    data = [doc(1, 0, node=None), doc(2, 0)]
    rows = run(spark, data, FieldRules())
    assert len(rows) == 1


def test_no_interval_is_full_export(spark):
    df = frame(spark, [doc(1, 0), doc(2, 1)])
    assert sample_buckets(df, ["node"], None) is df


def test_avg_mode_fallback(spark):
    data = [doc(1, 0, heap=1.0, note="a"), doc(2, 1, heap=3.0, note="b"), doc(3, 2, heap=5.0, note="b")]
    out = sample_buckets(frame(spark, data), ["node"], "15m", FieldRules(), fallback="avg_mode").collect()
    assert out[0]["heap"] == 3.0 and out[0]["note"] == "b" and out[0]["_id"] == "3"


def test_non_numeric_max_degrades_to_latest(spark):
    data = [doc(1, 0, note="12"), doc(2, 1, note="x")]
    out = sample_buckets(frame(spark, data), ["node"], "15m", FieldRules(max=("note",))).collect()
    # text has no bucket maximum: the newest document's value stays
    assert out[0]["note"] == "x"


def test_group_columns_probe(spark):
    df = frame(spark, [doc(1, 0)])
    assert resolve_group_columns(df, ["node", "note"]) == ["node"]
    assert resolve_group_columns(df, ["missing"]) == ["missing"]
    assert resolve_group_columns(df, ["node", "note"], fixed=True) == ["node", "note"]


def test_properties_partitioning_and_slices(spark):
    """Result independent of partition count; one row per (group, bucket);
    aligned slices union to the one-run result for latest and max columns."""
    import random

    rnd = random.Random(7)
    data = [doc(i, rnd.randrange(0, 600), f"n{rnd.randrange(4)}", index_total=rnd.randrange(0, 10_000), heap=rnd.random())
            for i in range(400)]
    df = frame(spark, data)
    rules = FieldRules(rate=("index_total",), max=("heap",))
    a = sorted(map(tuple, sample_buckets(df.repartition(1), ["node"], "30m", rules).collect()))
    b = sorted(map(tuple, sample_buckets(df.repartition(7), ["node"], "30m", rules).collect()))
    assert a == b
    groups = df.select("node", (F.floor(F.unix_micros("timestamp") / 1_800_000_000)).alias("b")).distinct().count()
    assert len(a) == groups
    cut = T0 + timedelta(minutes=300)
    lo = df.where(F.col("timestamp") < F.lit(cut))
    hi = df.where(F.col("timestamp") >= F.lit(cut))
    sl = FieldRules(max=("heap",))
    one = sorted(map(tuple, sample_buckets(df, ["node"], "30m", sl).collect()))
    two = sorted(map(tuple, sample_buckets(lo, ["node"], "30m", sl).unionByName(sample_buckets(hi, ["node"], "30m", sl)).collect()))
    assert one == two


def test_estimate(spark):
    data = [doc(i, i % 60, f"n{i % 2}") for i in range(100)]
    df = frame(spark, data)
    start, end = T0, T0 + timedelta(hours=24)
    from datetime import timezone
    r = estimate_sample_size(df, ["node"], "15m", start.replace(tzinfo=timezone.utc), end.replace(tzinfo=timezone.utc)).first()
    assert r["rows"] == 100 and r["groups"] == 2 and r["buckets"] == 97 and r["estimate"] == 100
    actual = sample_buckets(df, ["node"], "15m").count()
    assert r["estimate"] >= actual
