"""Resumed, concurrent and split exports; documents with undeclared fields."""

import json
import os
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import jsontext
from fleetlens.operators.shape import IPV4_PATTERN, IPV4_REPLACEMENT, SlimConfig, mask_ipv4, shape_variant, shape_variant_text
from fleetlens.plans import job as J
from fleetlens.plans.job import ExportJob, manifest, run_export_job
from fleetlens.sinks.writers import file_row_counts, planned_files, write_json_lines
from fleetlens.sources import adaptors, restfields

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("metrics") / "store")
    docs = adaptors.metric_documents(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    docs.write.parquet(path)
    return path, docs.count()


def files_of(path):
    """Name and content of every data file below ``path``; task ids cut off."""
    out = Counter()
    for folder, _, names in os.walk(path):
        for n in names:
            if n.startswith("part-"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    out[os.path.relpath(folder, path), tuple(sorted(f.read().splitlines()))] += 1
    return out


def test_killed_job_resumes_without_loss_or_repeat(spark, store, tmp_dir, monkeypatch):
    path, total = store

    def job(out):
        return ExportJob(name="r", output_path=out, metrics_path=path, metric_types=["node_stats"], start="2024-01-01", end="2024-01-31", slice_interval="7d", mask=True, rows_per_file=50)

    whole = run_export_job(spark, job(f"{tmp_dir}/whole")).first()
    assert (whole["rows"], whole["error"], whole["slices_done_before"]) == (total, None, 0) and whole["slices"] > 3

    real, calls = J._write, []

    def dies(df, at, *rest):
        calls.append(at)
        if len(calls) == 3:
            df.limit(3).write.mode("overwrite").json(at)  # half a slice is on disk
            raise RuntimeError("killed")
        return real(df, at, *rest)

    monkeypatch.setattr(J, "_write", dies)
    broken = run_export_job(spark, job(f"{tmp_dir}/out")).first()
    assert "killed" in broken["error"] and manifest(spark, f"{tmp_dir}/out").count() == 2
    monkeypatch.setattr(J, "_write", real)
    again = run_export_job(spark, job(f"{tmp_dir}/out")).first()
    assert (again["rows"], again["error"], again["slices_done_before"]) == (total, None, 2)
    assert files_of(f"{tmp_dir}/out/node_stats") == files_of(f"{tmp_dir}/whole/node_stats")
    entered = manifest(spark, f"{tmp_dir}/out").orderBy("low").collect()
    assert len(entered) == whole["slices"] and sum(r["rows"] for r in entered) == total
    for r in entered:
        counts = file_row_counts(spark, r["path"]).collect()
        assert sum(c["rows"] for c in counts) == r["rows"] and (r["rows"] == 0 or r["low"] <= r["last_time"] < r["high"])
        assert r["files"] >= len(counts)
    # a third run writes nothing, other settings write everything
    third = run_export_job(spark, job(f"{tmp_dir}/out")).first()
    assert third["slices_done_before"] == third["slices"] and third["rows"] == total
    other = job(f"{tmp_dir}/out")
    other.mask = False
    assert run_export_job(spark, other).first()["slices_done_before"] == 0


def test_slices_cover_the_window():
    j = ExportJob(name="s", output_path="", start="2024-01-01 05:00", end="2024-01-03 01:00", slice_interval="1d")
    cut = J.slices(j, True)
    assert cut[0][0] == T0 + timedelta(hours=5) and cut[-1][1] == T0 + timedelta(hours=49, microseconds=1)
    assert [a for a, _ in cut[1:]] == [b for _, b in cut[:-1]] == [T0 + timedelta(days=1), T0 + timedelta(days=2)]
    assert len(J.slices(j, False)) == 1
    j.sampling_interval = "1h"
    assert len(J.slices(j, True)) == 1


def slept(ms):
    """A column that takes so long."""
    return F.expr(f"java_method('java.lang.Thread', 'sleep', {ms}L)").alias("slept")


def test_types_overlap_and_fail_alone(spark, store, tmp_dir, monkeypatch):
    def documents(spark, job, name, clusters):
        if name == "index_stats":
            raise ValueError("no such type")
        return spark.range(1, numPartitions=1).select("id", slept(2500))

    monkeypatch.setattr(J, "metric_documents", documents)
    job = ExportJob(name="p", output_path=tmp_dir, metrics_path=store[0], metric_types=["node_stats", "index_stats", "shard_stats"], parallel=3)
    rows = run_export_job(spark, job).collect()
    assert [r["type"] for r in rows] == ["node_stats", "index_stats", "shard_stats"]
    assert [r["error"] is None for r in rows] == [True, False, True] and rows[0]["rows"] == rows[2]["rows"] == 1
    first, last = rows[0], rows[2]
    assert max(first["started"], last["started"]) < min(r["started"] + timedelta(seconds=r["seconds"]) for r in (first, last))
    assert all(r["seconds"] >= 2.4 for r in (first, last))


def test_one_type_is_cancelled(spark, store, tmp_dir, monkeypatch):
    import threading

    def documents(spark, job, name, clusters):
        return spark.range(1, numPartitions=1).select("id", slept(20_000 if name == "node_stats" else 10))

    monkeypatch.setattr(J, "metric_documents", documents)
    job = ExportJob(name="c", output_path=tmp_dir, metrics_path=store[0], metric_types=["node_stats", "shard_stats"])
    timer = threading.Timer(3, lambda: spark.sparkContext.cancelJobsWithTag(J.job_tag(job, "node_stats")))
    timer.start()
    rows = {r["type"]: r for r in run_export_job(spark, job).collect()}
    timer.join()
    assert rows["node_stats"]["error"] and rows["node_stats"]["seconds"] < 15 and rows["shard_stats"]["error"] is None


def test_split_gives_full_files(spark, tmp_dir):
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 40, None).otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("cluster"), F.lit("x").alias("v"))
    docs = docs.union(docs.where("_id < 30"))  # repeated rows
    write_json_lines(planned_files(docs, ["cluster"], 100, ["_id"]), f"{tmp_dir}/out", 100, ["cluster"])
    rows = {r["cluster"]: r["n"] for r in docs.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    files = {}
    for r in file_row_counts(spark, f"{tmp_dir}/out").collect():
        name = r["file"].split("cluster=")[1].split("/")[0]
        files.setdefault(None if "HIVE_DEFAULT" in name else name, []).append(r["rows"])
    assert {c: sum(x) for c, x in files.items()} == rows
    assert all(len(files[c]) == -(-k // 100) and max(files[c]) <= 100 for c, k in rows.items())
    back = spark.read.json(f"{tmp_dir}/out")
    assert sorted(map(str, back.select("_id", "v").collect())) == sorted(map(str, docs.select("_id", "v").collect()))


SCHEMA = T.StructType().add("_id", "string").add("timestamp", "timestamp").add("n", "long").add("metadata", T.StructType().add("name", "string").add("labels", T.StructType().add("cluster_id", "string")))
LINES = [
    {"_id": "a", "timestamp": "2024-01-01T00:00:01.000Z", "n": 1, "metadata": {"name": "node_stats", "labels": {"cluster_id": "c", "zone": "198.51.100.7"}, "more": [1, {"x": None}]}, "top": {"store": "1kb", "deep": {"y": 2}}},
    {"_id": "b", "timestamp": "2024-01-01T00:00:02.000Z", "n": "no number", "metadata": {"name": "node_stats", "labels": "text"}, "": 5},
    {"_id": "c", "timestamp": "2024-01-01T00:00:03.000Z", "n": None, "metadata": {"name": "node_stats", "labels": {}}},
    {"_id": "d", "n": 4, "metadata": {"name": "shard_stats"}},
    [1],
    "text",
]


@pytest.fixture()
def lines(tmp_dir):
    os.makedirs(f"{tmp_dir}/json")
    with open(f"{tmp_dir}/json/docs.json", "w", encoding="utf-8") as f:
        f.write("\n".join(json.dumps(x) for x in LINES) + "\n\nnot json\n")
    return f"{tmp_dir}/json"


def padded(doc):
    """What a whole document reads as: declared fields that are missing are null."""
    out = {"_id": None, "timestamp": None, "n": None, "metadata": None, **doc}
    if isinstance(out["metadata"], dict):
        out["metadata"] = {"name": None, "labels": None, **out["metadata"]}
        if isinstance(out["metadata"]["labels"], dict):
            out["metadata"]["labels"] = {"cluster_id": None, **out["metadata"]["labels"]}
    return out


def test_rest_keeps_every_field(spark, lines):
    df = restfields.read_with_rest(spark, lines, SCHEMA)
    assert df.schema["metadata"].dataType == SCHEMA["metadata"].dataType
    got = {r["_id"]: r for r in df.select("*", F.to_json(restfields.whole_document(df)).alias("j")).collect()}
    assert {i: json.loads(r["j"]) for i, r in got.items()} == {d["_id"]: padded(d) for d in LINES[:4]}
    assert got["a"]["n"] == 1 and got["b"]["n"] is None and got["b"]["metadata"]["labels"] is None
    with pytest.raises(ValueError, match="VARIANT"):
        restfields.read_with_rest(spark, lines, T.StructType().add("l", T.ArrayType(T.StructType().add("a", "long"))))


@pytest.mark.parametrize("split", [None, "cluster"])
def test_export_loses_no_undeclared_field(spark, lines, tmp_dir, split):
    job = ExportJob(name="k", output_path=f"{tmp_dir}/out{split}", metrics_path=lines, metrics_format="json", metric_types=["node_stats"], schemas={"node_stats": SCHEMA},
                    start="2024-01-01", end="2024-01-02", keep_rest=True, mask=True, slim=SlimConfig(enabled=True), split_by=split)
    assert run_export_job(spark, job).first()["rows"] == 3
    out = [json.loads(r["value"]) for r in spark.read.option("recursiveFileLookup", "true").text(f"{job.output_path}/node_stats").collect()]
    assert {json.dumps(d, sort_keys=True) for d in out} == {
        json.dumps(d, sort_keys=True)
        for d in (
            {"timestamp": "2024-01-01T00:00:01.000Z", "n": 1, "metadata": {"labels": {"cluster_id": "c", "zone": "*.*.100.7"}, "more": [1, {"x": None}]}, "top": {"deep": {"y": 2}}},
            {"timestamp": "2024-01-01T00:00:02.000Z", "n": "no number", "metadata": {"labels": "text"}, "": 5},
            {"timestamp": "2024-01-01T00:00:03.000Z", "n": None, "metadata": {"labels": {"cluster_id": None}}},
        )
    }


def test_rest_survives_sampling(spark, lines, tmp_dir):
    schema = T.StructType(SCHEMA.fields[:3]).add("metadata", T.StructType().add("name", "string").add("labels", T.StructType().add("cluster_id", "string").add("node_id", "string")))
    with open(f"{lines}/docs.json", "w", encoding="utf-8") as f:
        for i in range(4):
            f.write(json.dumps({"_id": str(i), "timestamp": f"2024-01-01T00:0{i}:00.000Z", "n": i, "metadata": {"name": "node_stats", "labels": {"cluster_id": "c", "node_id": str(i % 2), "extra": i}}, "also": [i]}) + "\n")
    job = ExportJob(name="k", output_path=f"{tmp_dir}/out", metrics_path=lines, metrics_format="json", metric_types=["node_stats"], schemas={"node_stats": schema},
                    start="2024-01-01", end="2024-01-02", keep_rest=True, sampling_interval="1h", source_fields=["n", "also", "metadata.labels.extra"])
    assert run_export_job(spark, job).first()["rows"] == 2
    out = sorted((json.loads(r["value"]) for r in spark.read.text(f"{tmp_dir}/out/node_stats").collect()), key=lambda d: d["n"])
    assert out == [{"n": i, "also": [i], "metadata": {"labels": {"extra": i}}} for i in (2, 3)]


def test_a_line_is_parsed_and_read_once(spark, lines):
    job = ExportJob(name="k", output_path="", metrics_path=lines, metrics_format="json", schemas={"node_stats": SCHEMA}, start="2024-01-01", end="2024-01-02", keep_rest=True)
    docs = J.metric_documents(spark, job, "node_stats")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("try_variant_get(v#") == plan.count("MapType(") + 1
    assert sorted(r["_id"] for r in docs.collect()) == ["a", "b", "c"]


ODD = [
    {"s": "10.1.2.3", "store": 1, "metadata": {"name": "x", "store": "kept 10.1.2.3"}, "agent": 1, "_id": "x"},
    {"a": {"store": "x", "limit_size": None, "b": [{"store": True}, {"c": 1, "estimated_size": 2, "store": {"store": 3, "d": 4}}]}},
    {"t": ["\n10.1.2.3\t", "\\10.1.2.3", 'q"10.1.2.3"', "x10.1.2.3", "1.2.3.4.5", "\u00010.1.2.3", "\u001f10.1.2.3", "é10.1.2.3", '"store":1,', ',"store":1'], "10.1.2.3": {"k 10.1.2.3\"": "10.1.2.3", 'say "store': 1}},
    {"metadata": "text 10.1.2.3", "": {"": "store"}, "v": "1.0, x", "l": [], "o": {}},
]
WHOLE = ['{"a":{"x":1e2,"y":[100.0,1.0e2],"z":-0.0e0},"metadata":{"m":1e2,"n":"1.0}"}}', '{"a":1.10,"b":1e400,"c":123456789012345678901234567890123456789012}']


@pytest.mark.parametrize("mask", [False, True])
@pytest.mark.parametrize("slim", [None, SlimConfig(enabled=True), SlimConfig(enabled=True, remove_meta=False), SlimConfig(enabled=True, remove_human_readable=False)])
def test_shaped_text_is_that_of_the_shaped_value(spark, mask, slim):
    df = spark.createDataFrame([(json.dumps(d),) for d in ODD] + [(t,) for t in WHOLE], "t string").select(F.parse_json("t").alias("v"))
    by_value, by_text = F.to_json(shape_variant(F.col("v"), None, mask, slim)), shape_variant_text(F.col("v"), None, mask, slim)
    for r in df.select(by_value.alias("a"), by_text.alias("b")).collect():
        assert r["a"] == r["b"]


def test_strings_are_masked_in_the_text(spark):
    texts = spark.createDataFrame([(json.dumps(d),) for d in ODD], "t string").select(F.to_json(F.parse_json("t")).alias("t"))
    by_token = jsontext.map_json_strings(F.col("t"), mask_ipv4, r"[0-9]\.[0-9]")
    rows = texts.select(by_token.alias("a"), jsontext.replace_in_json_strings(F.col("t"), IPV4_PATTERN, IPV4_REPLACEMENT).alias("b")).collect()
    assert [r["b"] for r in rows] == [r["a"] for r in rows] and "*.*.2.3" in rows[0]["b"]


def test_members_are_dropped_with_and_without_blanks(spark):
    def dropped(v):
        if isinstance(v, dict):
            return {k: dropped(x) for k, x in v.items() if k not in ("store", "limit_size") or isinstance(x, (dict, list))}
        return [dropped(x) for x in v] if isinstance(v, list) else v

    for compact, how in ((True, {"separators": (",", ":")}), (False, {"indent": 1}), (False, {"separators": (" , ", " : ")})):
        texts = spark.createDataFrame([(i, json.dumps(d, **how)) for i, d in enumerate(ODD)], "i int, t string")
        out = texts.orderBy("i").select(jsontext.drop_scalar_members(F.col("t"), ["store", "limit_size"], compact).alias("o")).collect()
        assert [json.loads(r["o"]) for r in out] == [dropped(d) for d in ODD]


def test_documents_with_whole_doubles_and_other_kinds(spark, tmp_dir):
    docs = [
        '{"_id":"a","n":1,"metadata":{"name":"node_stats","labels":{"x":1e2,"y":[100.0]}},"top":{"z":1e2}}',
        '{"_id":5,"n":{"x":1},"metadata":{"name":["no text"],"labels":[1]},"timestamp":"no time"}',
        '{"_id":null,"n":1.0,"metadata":null,"more":"1.0,"}',
    ]
    with open(f"{tmp_dir}/docs.json", "w", encoding="utf-8") as f:
        f.write("\n".join(docs))
    df = restfields.read_with_rest(spark, f"{tmp_dir}/docs.json", SCHEMA)
    got = [r["j"] for r in df.select(F.to_json(restfields.whole_document(df)).alias("j")).collect()]
    assert got == [
        '{"_id":"a","metadata":{"labels":{"cluster_id":null,"x":100.0,"y":[100]},"name":"node_stats"},"n":1,"timestamp":null,"top":{"z":100.0}}',
        '{"_id":"5","metadata":{"labels":[1],"name":"[\\"no text\\"]"},"n":{"x":1},"timestamp":"no time"}',
        '{"_id":null,"metadata":null,"more":"1.0,","n":1,"timestamp":null}',
    ]
