"""Formatting and path functions (FIXTURES §2.5, §2.6)."""

from pyspark.sql import functions as F

from fleetlens.functions import scalars
from fleetlens.functions.timeutil import parse_interval_ms, parse_time_input, resolve_time_window
from fleetlens.operators.filters import target_predicate

import pytest


def one(spark, col, value, dtype):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(col(F.col("v")).alias("r")).first()["r"]


def test_format_bytes(spark):
    f = scalars.format_bytes
    assert one(spark, f, 0, "bigint") == "0 B"
    assert one(spark, f, None, "bigint") == "0 B"
    assert one(spark, f, 512, "bigint") == "512.00 B"
    assert one(spark, f, 1024, "bigint") == "1.00 KB"
    assert one(spark, f, 1024**2, "bigint") == "1.00 MB"
    assert one(spark, f, 1024**3, "bigint") == "1.00 GB"
    assert one(spark, f, 1152, "bigint") == "1.12 KB"
    assert one(spark, f, -2048, "bigint") == "-2.00 KB"


def test_format_duration(spark):
    f = scalars.format_duration
    assert one(spark, f, 0, "bigint") == "0s"
    assert one(spark, f, None, "bigint") == "0s"
    assert one(spark, f, 5000, "bigint") == "5s"
    assert one(spark, f, 65000, "bigint") == "1m 5s"
    assert one(spark, f, 3661000, "bigint") == "1h 1m"
    assert one(spark, f, 86400000, "bigint") == "1d"
    assert one(spark, f, 500, "bigint") == "0s"


def test_format_count(spark):
    f = scalars.format_count
    assert one(spark, f, 8516, "bigint") == "8,516"
    assert one(spark, f, -1000, "bigint") == "-1,000"
    assert one(spark, f, None, "bigint") == "-"
    assert one(spark, f, "12345", "string") == "12,345"
    assert one(spark, f, "abc", "string") == "abc"


def test_targets_and_search_paths(spark):
    def t(path):
        return one(spark, scalars.target_names, path, "string")

    assert t("movies/_search") == ["movies"]
    assert t("index1,index2/_search") == ["index1", "index2"]
    assert t("_cluster/health") == [] and t("/_cat/indices") == [] and t("") == [] and t("/") == []
    assert t("movies/_search?size=10") == ["movies"]
    assert one(spark, scalars.is_msearch_path, "logs/_msearch?x=1", "string") is True
    assert one(spark, scalars.is_msearch_path, "logs/_search", "string") is False
    assert one(spark, scalars.is_search_path, "_search", "string") is True


def test_nanos_and_percent(spark):
    assert one(spark, scalars.nanos_to_ms, 1234567, "bigint") == 1.235
    df = spark.createDataFrame([(1, 3), (5, 0)], "u long, t long").select(scalars.used_percent("u", "t").alias("p"))
    assert [r["p"] for r in df.collect()] == [33.33, 0.0]


def test_globs(spark):
    df = spark.createDataFrame(
        [("cluster-1",), ("cluster-3",), ("test-1",), ("prod-1",), ("us-prod-1",), ("us-prod-test",), ("us-dev-1",), ("test-cluster",), ("cluster-test",)],
        "v string",
    )

    def keep(inc, exc):
        return {r["v"] for r in df.where(target_predicate(F.col("v"), F.col("v"), inc, exc)).collect()}

    assert len(keep(None, None)) == 9
    assert keep(["cluster-1", "cluster-2"], None) == {"cluster-1"}
    assert "test-1" not in keep(None, ["test-*"]) and "prod-1" in keep(None, ["test-*"])
    assert keep(["*-prod-*"], ["*-prod-test"]) == {"us-prod-1"}
    assert keep(["*-cluster"], None) == {"test-cluster"}
    assert keep(["cluster-[13]"], None) == {"cluster-1", "cluster-3"}


def test_time_inputs():
    from datetime import datetime, timezone

    assert parse_time_input("2026-04-03 11:38:46") == datetime(2026, 4, 3, 11, 38, 46, tzinfo=timezone.utc)
    assert parse_time_input("2026-04-03", is_end=True) == datetime(2026, 4, 3, 23, 59, 59, tzinfo=timezone.utc)
    assert parse_time_input("2026-04-03T10:00:00Z") == datetime(2026, 4, 3, 10, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        parse_time_input("2026/04/03")
    with pytest.raises(ValueError):
        resolve_time_window(1, "2026-04-04", "2026-04-03")
    assert parse_interval_ms("15m") == 900_000 and parse_interval_ms("2h") == 7_200_000
    with pytest.raises(ValueError):
        parse_interval_ms("15x")


def test_labels_json_and_glob_negation(spark):
    assert one(spark, lambda c: scalars.strip_label(c, ["original", "optimized"]), "q1 (optimized)", "string") == "q1"
    assert one(spark, lambda c: scalars.strip_label(c, ["original", "optimized"]), "q1 (other)", "string") == "q1 (other)"
    assert one(spark, scalars.json_compact, '{ "a" : [1, 2] }', "string") == '{"a":[1,2]}'
    assert one(spark, scalars.json_compact, "{broken", "string") is None
    import re

    assert re.match(scalars.glob_to_regex("node-[!0-4]"), "node-7") and not re.match(scalars.glob_to_regex("node-[!0-4]"), "node-3")
    assert re.match(scalars.glob_to_regex("a.b*"), "a.bc") and not re.match(scalars.glob_to_regex("a.b*"), "axbc")
    assert parse_interval_ms(5000) == 5000


def test_drop_blank_edge_lines(spark):
    f = lambda c: scalars.drop_blank_edge_lines(c)
    assert one(spark, f, "\n  \n  {a}  \n\n  {b} \n \n", "string") == "  {a}  \n\n  {b} "
    assert one(spark, f, " \n \t\n", "string") == ""
    g = lambda c: scalars.drop_blank_edge_lines(c, skip_first_line=True)
    assert one(spark, g, "GET x\n\n{a}\n\n", "string") == "{a}"


def test_time_window_bounds():
    from datetime import datetime, timedelta, timezone

    now = datetime(2026, 4, 3, 12, 0, tzinfo=timezone.utc)
    assert resolve_time_window(2, now=now) == (now - timedelta(hours=2), now)
    lo, hi = resolve_time_window(3, end="2026-04-03", now=now)
    assert hi == datetime(2026, 4, 3, 23, 59, 59, tzinfo=timezone.utc) and lo == hi - timedelta(hours=3)
    lo, hi = resolve_time_window(3, start="2026-04-03 11:38:46", now=now)
    assert lo == datetime(2026, 4, 3, 11, 38, 46, tzinfo=timezone.utc) and hi == now
