"""Caps that are gone, wrong answers that were mended."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalars, timeutil
from fleetlens.operators import benchruns, filters, fleet, joins, requests, sampling, shape
from fleetlens.session import checkpoint_dir

UTC = timezone.utc


def test_all_clusters_are_kept(spark):
    m = spark.range(1001).select(F.col("id").alias("cluster_id"), F.lit("n").alias("cluster_name"))
    assert fleet.active_clusters(m).count() == 1001 and fleet.active_clusters(m, top=7).count() == 7


def test_deep_objects_are_flattened_to_the_leaf(spark):
    text = "1"
    for k in range(20):
        text = f'{{"k{k}":{text},"s{k}":"{{}}"}}'
    got = {r.key: r.value for r in shape.flatten_json(spark.createDataFrame([(1, text), (2, '{"a":{}}'), (3, '{"a":1}')], "id long, j string"), ["id"], "j").where("id < 3").collect()}
    assert got[".".join(f"k{k}" for k in range(19, -1, -1))] == "1" and len(got) == 21 and set(got.values()) == {"1", "{}"}


def test_count_text_of_any_length(spark):
    values = ["1" * 40, "-1234567", "007", "-0", "12", "abc", " 5 ", "", None]
    got = [r.c for r in spark.createDataFrame([(v,) for v in values], "v string").select(scalars.format_count("v").alias("c")).collect()]
    assert got == [f"{int('1' * 40):,}", "-1,234,567", "7", "0", "12", "abc", "5", "-", "-"]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("[[]x", ["[x"], ["x", "]x"]), ("[a&&b]", ["a", "&", "b"], ["c"]), ("[!a-c]?", ["dz"], ["az", "d"]), ("[]]", ["]"], ["["]), ("[z-a]", [], ["a", "z", "-"]),
     ("[", ["["], ["x"]), ("a.*", ["a.b"], ["ab"]), ("[^a]", ["^", "a"], ["b"]), ("[a-]", ["a", "-"], ["b"]), ("x\ny*", ["x\nyz\n"], ["x"])],
)
def test_globs(spark, glob, yes, no):
    import fnmatch

    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    got = {r.v for r in df.where(scalars.matches_any_glob("v", [glob])).collect()}
    assert got == set(yes)
    assert all(fnmatch.fnmatchcase(v, glob) for v in yes) and not any(fnmatch.fnmatchcase(v, glob) for v in no)


def test_time_bounds():
    parse = timeutil.parse_time_input
    assert parse("2024-01-02") == datetime(2024, 1, 2, tzinfo=UTC)
    assert parse(" 2024-01-02 ", is_end=True) == datetime(2024, 1, 2, 23, 59, 59, tzinfo=UTC)
    assert parse("2024-01-02 03:04:05", is_end=True) == datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)
    assert parse("2024-01-02T03:04:05.25+02:30") == datetime(2024, 1, 2, 0, 34, 5, 250000, tzinfo=UTC)
    assert parse("2024-01-02T03:04:05-0130") == datetime(2024, 1, 2, 4, 34, 5, tzinfo=UTC)
    assert parse("2024-1-5") == parse("20240105") == datetime(2024, 1, 5, tzinfo=UTC)
    assert parse("2024-1-5", is_end=True) == datetime(2024, 1, 5, 23, 59, 59, tzinfo=UTC)
    assert parse("20240105", is_end=True) == datetime(2024, 1, 5, tzinfo=UTC)  # only dashes mean the whole day
    assert parse("2024-01-05T10") == parse("20240105T1000") == parse("2024-1-5 10:0:0") == parse("20240105 100000Z") == datetime(2024, 1, 5, 10, tzinfo=UTC)
    assert parse("2024-01-05T10:30+02") == datetime(2024, 1, 5, 8, 30, tzinfo=UTC)
    for bad in ("", None, "yesterday", "2024-13-01", "2024-01-02 99:00:00", "2024-1", "202401", "2024-01-05 1:2:3:4"):
        with pytest.raises(ValueError):
            parse(bad)
    now = datetime(2024, 1, 5, 12, tzinfo=UTC)
    window = timeutil.resolve_time_window
    assert window(2, now=now) == (datetime(2024, 1, 5, 10, tzinfo=UTC), now)
    assert window(2, end="2024-01-04 02:00:00", now=now) == (datetime(2024, 1, 4, tzinfo=UTC), datetime(2024, 1, 4, 2, tzinfo=UTC))
    assert window(2, start="2024-01-04", now=now) == (datetime(2024, 1, 4, tzinfo=UTC), now)
    with pytest.raises(ValueError):
        window(start="2024-01-06", now=now)


def test_nested_time_column(spark):
    df = spark.sql("select named_struct('ts', timestamp_ntz'2024-01-01 10:00:00') as a, 'g' as g, '1' as _id")
    assert filters.time_window(df, "a.ts", "2024-01-01", "2024-01-01").count() == 1
    assert sampling.add_bucket(df, "1h", "a.ts").first().bucket_ms == 1704103200000


def sampled(spark, rows, rules, **options):
    df = spark.createDataFrame([(str(i), t, "g", *v) for i, (t, *v) in enumerate(rows)], "_id string, timestamp timestamp, g string, t double, n double, s string")
    return sampling.sample_buckets(df, ["g"], "1h", rules, **options).orderBy("bucket_ms").collect()


def test_text_maximum_keeps_the_newest_value(spark):
    rows = [(datetime(2024, 1, 1, 1, 10), 1.0, 1.0, "9"), (datetime(2024, 1, 1, 1, 50), 1.0, 1.0, "5")]
    assert [r.s for r in sampled(spark, rows, sampling.FieldRules(max=("s",)))] == ["5"]


def test_latency_spans_are_common(spark):
    rows = [(datetime(2024, 1, 1, h), t, n, None) for h, t, n in ((1, 10.0, 1.0), (2, 20.0, None), (3, 30.0, 3.0))]
    assert [r.lat for r in sampled(spark, rows, sampling.FieldRules(latency={"lat": ("t", "n")}))] == [None, None, 10.0]


def test_modes_need_no_buffer_and_null_groups(spark):
    rows = [(datetime(2024, 1, 1, 1, m), 1.0, None, s) for m, s in ((1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None))]
    assert [(r.s, r.t) for r in sampled(spark, rows, None, fallback="avg_mode")] == [("a", 1.0)]
    df = spark.createDataFrame([("1", datetime(2024, 1, 1), None, "x"), ("2", datetime(2024, 1, 1), "g", "y")], "_id string, timestamp timestamp, g string, s string")
    assert sampling.sample_buckets(df, ["g"], "1h", fallback="avg_mode").count() == 1
    kept = sampling.sample_buckets(df, ["g"], "1h", fallback="avg_mode", drop_null_groups=False)
    assert sorted(r.s for r in kept.collect()) == ["x", "y"]


def test_fields_prune_the_scan(spark, tmp_dir):
    rows = spark.range(10).selectExpr("cast(id as string) _id", "timestamp_millis(id * 1000) timestamp", "'g' g", "named_struct('a', id, 'b', id, 'c', cast(id as string)) p", "'wide' unused")
    rows.write.parquet(f"{tmp_dir}/t")
    out = sampling.sample_buckets(spark.read.parquet(f"{tmp_dir}/t"), ["g"], "1h", sampling.FieldRules(rate=("p.a",), max=("p.b",)), fields=["p.b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "unused" not in schema and "b:bigint" in schema and "a:bigint" not in schema and "c:string" not in schema
    assert out.collect()[0].p.b == 9


def test_requests_with_tabs_and_single_quotes(spark):
    text = "\t# One\t\n\tGET idx/_search \n{'a':1}\n# Two\nPOST idx/_search\n{\"a\": 1}\n# Three\nPOST /_msearch\n{}\n{}\n"
    got = requests.parse_requests(spark.createDataFrame([("f", text)], "file_id string, text string")).orderBy("seq").collect()
    assert [(r.title, r.method, r.path, r.error) for r in got] == [
        ("One", "GET", "idx/_search", requests.ERR_BAD_JSON), ("Two", "POST", "idx/_search", None), ("Three", "POST", "/_msearch", None)]
    assert got[2].body_raw == "{}\n{}" and got[2].body_sent == "{}\n{}\n"


@pytest.mark.parametrize("limit", [10, 0])
def test_lookup_join_both_ways(spark, limit):
    facts = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, x int")
    lookup = spark.createDataFrame([("a", 1), ("c", 2)], "k string, y int")
    got = joins.lookup_join(facts, lookup, "k", limit=limit)
    assert got.count() == 52 and got.where("y = 1").count() == 50
    assert joins.lookup_join(facts, lookup, "k", "inner", limit=limit).count() == 50


def test_pair_cell_keeps_the_last_execution_and_rounds(spark):
    runs = spark.createDataFrame(
        [(0, "q", "original", 1, 1, 5.0), (0, "q", "original", 2, 3, 7.0), (0, "q", "original", 2, 2, 9.0), (0, "p", "optimized", 2, 4, 1.0), (1, "z", "other", 2, 5, 1.0)],
        "query_index int, base_name string, query_type string, iteration int, seq int, took double",
    ).withColumns({"duration": F.lit(1.0), "success": F.lit(True)})
    (cell,) = benchruns.pair_matrix(benchruns.number_rounds(runs, 1)).collect()
    assert (cell.measured_iteration, cell.original_took, cell.optimized_took, cell.display_name) == (1, 7.0, 1.0, "q vs p")


def test_names_resolve_by_short_and_ambiguous_pieces(spark):
    reg = spark.createDataFrame([("1", "Alpha One"), ("2", "alpha two"), ("3", "Beta"), ("4", None)], "id string, name string")
    req = spark.createDataFrame([("Beta",), ("BETA",), ("o",), ("one",), ("a t",), ("zz",), ("",)], "name string")
    got = {r.name: (r.cluster_id, r.match_type, r.candidates, r.status) for r in fleet.resolve_cluster_names(req, reg).collect()}
    assert got == {
        "Beta": ("3", "exact", 1, "ok"), "BETA": ("3", "case_insensitive", 1, "ok"), "o": (None, "substring", 2, "ambiguous"),
        "one": ("1", "substring", 1, "ok"), "a t": ("2", "substring", 1, "ok"), "zz": (None, None, 0, "not_found")}


def test_shared_folder_is_the_setting(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_cluster_list_and_type_filters(spark):
    df = spark.createDataFrame([("a", "m"), ("b", "n")], "c string, t string")
    assert filters.cluster_filter(df, "c", "a").count() == 1 and filters.cluster_filter(df, "c", ["a", "b"]).count() == 2
    assert filters.metric_type_filter(df, "m", "t").count() == 1


@pytest.mark.parametrize(("interval", "want"), [("500ms", [0, 1000, 1500]), ("1500ms", [0, 1500])])
def test_stream_windows_of_part_seconds(spark, interval, want):
    from fleetlens.streaming.sampler import stream_buckets

    df = spark.createDataFrame([("a", 0.1), ("a", 1.4), ("a", 1.6)], "g string, s double").selectExpr("g", "cast(s * 10 as string) _id", "timestamp_millis(cast(s * 1000 as bigint)) timestamp")
    assert [r.bucket_ms for r in stream_buckets(df, ["g"], interval, "1 second").orderBy("bucket_ms").collect()] == want


def test_compact_json_keeps_order_and_strings(spark):
    rows = [('{ "b" : 1.0,\n "a" : [ 1, "x  \\" , y" ] }', '{"b":1.0,"a":[1,"x  \\" , y"]}'), ("{'a': 1}", None), ("nope", None), (None, None), ('"' + "\\n " * 3000 + '"', '"' + "\\n " * 3000 + '"')]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r.got for r in df.select(scalars.json_compact("t").alias("got")).collect()] == [w for _, w in rows]
