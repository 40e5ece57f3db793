"""Benchmark comparison and profile roll-up (FIXTURES §2.8)."""

from pyspark.sql import functions as F

from fleetlens.operators import benchruns, profile

RUNS = (
    "name string, base_name string, query_type string, query_index int, iteration int, is_warmup boolean, "
    "measured_iteration int, took double, duration double, success boolean"
)


def run(name, qtype, it, took, dur, ok=True, warm=2):
    return (f"{name} ({qtype})", name, qtype, 0, it, it <= warm, it - warm if it > warm else None, took, dur, ok)


def test_compare_took_and_fallback(spark):
    rows = [run("q1", "original", 3, 150.5, 200.0), run("q1", "optimized", 3, 120.2, 190.0),
            run("q2", "original", 3, None, 100.0), run("q2", "optimized", 3, 50.0, 80.0),
            run("q3", "original", 3, 0.0, 10.0), run("q3", "optimized", 3, 1.0, 10.0)]
    got = {r["base_name"]: r for r in benchruns.compare_sides(spark.createDataFrame(rows, RUNS)).collect()}
    assert got["q1"]["metric"] == "took" and got["q1"]["improvement_percent"] == 20.13 and got["q1"]["is_faster"] is True
    assert got["q2"]["metric"] == "duration" and got["q2"]["improvement_percent"] == 20.0
    assert got["q3"]["improvement_percent"] is None


def test_warmup_and_summary(spark):
    rows = [run("q", "original", i, float(i), float(i), ok=i != 5) for i in range(1, 11)]
    df = spark.createDataFrame(rows, RUNS)
    m = benchruns.measured(df)
    assert sorted(r["measured_iteration"] for r in m.collect()) == list(range(1, 9))
    s = benchruns.run_summary(m).first()
    assert s["total"] == 8 and s["passed"] == 7 and s["failed"] == 1 and s["pass_rate"] == "87.50%"
    assert s["original_took_count"] == 8 and s["min_took"] == 3.0 and s["max_took"] == 10.0


def test_msearch_took(spark):
    df = spark.createDataFrame(
        [("x/_msearch", '{"took": 3, "responses": [{"took": 5}, {"took": 9}, {"took": 7}]}'),
         ("x/_msearch", '{"took": 3, "responses": [{"took": "5"}]}'),
         ("x/_search", '{"took": 4}'), ("x/_search", '{"took": "4"}')],
        "path string, body string",
    )
    got = [r["t"] for r in df.select(benchruns.took_from_response(F.col("path"), F.try_parse_json("body")).alias("t")).collect()]
    assert got == [9.0, 3.0, 4.0, None]


PROFILE = (
    "run_id int, profile struct<shards array<struct<id string, index string, node_id string, searches array<struct<"
    "rewrite_time long, query array<struct<type string, description string, time_in_nanos long, breakdown map<string,long>>>, "
    "collector array<struct<name string, reason string, time_in_nanos long>>>>, fetch struct<time_in_nanos long>, "
    "aggregations array<struct<time_in_nanos long>>>>>"
)


def test_profile_rollup(spark):
    q = lambda t, n: (t, t, n, {"score": 10, "score_count": 3, "next_doc": n})
    shards = [
        ("s0", "i", "n", [(5, [q("A", 1_000_000), q("B", 4_000_000)], [])], (2_000_000,), None),
        ("s1", "i", "n", [(7, [q("C", 3_000_000)], [])], (1_000_000,), [(3_000_000,)]),
        ("s2", "i", "n", [(0, [q("D", 7_000_000)], [])], None, None),
    ]
    df = spark.createDataFrame([(1, (shards,))], PROFILE)
    r = profile.profile_rollup(df).first()
    assert r["shard_count"] == 3 and r["total_query_time_ms"] == 15.0 and r["total_fetch_time_ms"] == 3.0
    assert r["total_aggregation_time_ms"] == 3.0 and r["total_rewrite_time_ms"] == 0.0
    s = profile.slowest_shard(df).first()
    assert s["shard_id"] == "s0"  # 7 ms total, tied with s1 and s2: the first wins
    top = [x["type"] for x in profile.top_query_components(df).orderBy("rank").collect()]
    assert top == ["D", "B", "C"]
    phases = {x["phase"]: x["time_ms"] for x in profile.top_breakdown_phases(df).collect()}
    assert "score_count" not in phases and phases["next_doc"] == 15.0 and phases["score"] == 0.0
