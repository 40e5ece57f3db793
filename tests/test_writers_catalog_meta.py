"""CSV / nested JSON / detail writers (K8-K11), mapping and settings unwrap (S9),
registry normalisation (S7), latest status (S14)."""

import glob

from pyspark.sql import functions as F

from fleetlens.operators import catalog, fleet
from fleetlens.operators.shape import flatten_variant
from fleetlens.sinks.writers import write_cluster_samples_json, write_csv_report, write_index_details, write_report
from fleetlens.sources.tables import normalize_registry


def test_csv_yes_no(spark, tmp_dir):
    df = spark.createDataFrame([("c1", True), ("c2", False)], "name string, available boolean")
    write_csv_report(df.coalesce(1), f"{tmp_dir}/csv", yes_no=["available"])
    text = "".join(open(f).read() for f in glob.glob(f"{tmp_dir}/csv/part-*.csv"))
    assert text.splitlines()[0] == "name,available" and "c1,yes" in text and "c2,no" in text


def test_nested_and_detail_json(spark, tmp_dir):
    samples = spark.createDataFrame(
        [("c1", "one", "a/b", 3, [(1, "d1", "{}")]), ("c1", "one", "x", 0, [])],
        "cluster_id string, cluster_name string, index_name string, doc_count long, "
        "sample_docs array<struct<doc_rank:int,_id:string,_source:string>>",
    )
    write_cluster_samples_json(samples, f"{tmp_dir}/nested")
    back = spark.read.json(f"{tmp_dir}/nested").orderBy("index_name").collect()
    assert [(r["cluster_id"], r["cluster_name"], r["index_name"]) for r in back] == [("c1", "one", "a/b"), ("c1", "one", "x")]
    write_index_details(samples, f"{tmp_dir}/details")
    assert spark.read.json(f"{tmp_dir}/details").count() == 2


def test_report_record_and_results(spark, tmp_dir):
    from fleetlens.operators import reports

    runs = spark.createDataFrame(
        [("q (original)", "q", "original", 0, 1, False, 1, 5.0, 7.0, True), ("q (original)", "q", "original", 0, 2, False, 2, None, 9.0, False)],
        "name string, base_name string, query_type string, query_index int, iteration int, is_warmup boolean, measured_iteration int, took double, duration double, success boolean",
    )
    write_report(reports.report_record(runs, F.lit("2024-01-31")), reports.run_rows(runs), f"{tmp_dir}/r")
    record = spark.read.json(f"{tmp_dir}/r/report").first()
    assert record.summary.total == 2 and record.summary.pass_rate == "50.00%" and set(record.field_descriptions.asDict()) == {"took", "duration"}
    results = spark.read.json(f"{tmp_dir}/r/results").orderBy("iteration").collect()
    assert [(r.status, r.took) for r in results] == [("success", 5.0), ("failure", None)]
    stats = {r.measure: (r.avg, r.sum) for r in reports.run_statistics(runs).collect()}
    assert stats == {"took": (5.0, 5.0), "duration": (7.0, 7.0)}


def test_unwrap_mapping_and_settings(spark):
    df = spark.createDataFrame(
        [("i1", '{"i1": {"mappings": {"properties": {"a": {"type": "text"}}}}}',
          '{"i1": {"settings": {"index": {"number_of_shards": "1", "blocks": {"read_only": "false"}}}}}'),
         ("i2", '{"other": {}}', '{"i2": {"settings": {"refresh_interval": "1s"}}}')],
        "index_name string, mapping_json string, settings_json string",
    )
    got = [r["m"] for r in df.select(F.to_json(catalog.unwrap_mapping(df)).alias("m")).collect()]
    assert got == ['{"properties":{"a":{"type":"text"}}}', '{"other":{}}']
    flat = {(r["index_name"], r["key"], r["value"]) for r in flatten_variant(df, ["index_name"], catalog.unwrap_settings(df), prefix="index").collect()}
    assert flat == {("i1", "index.number_of_shards", "1"), ("i1", "index.blocks.read_only", "false"), ("i2", "index.refresh_interval", "1s")}


def test_registry_and_latest_status(spark):
    reg = spark.createDataFrame([("a", None, None, True)], "id string, name string, enabled boolean, monitored boolean")
    r = normalize_registry(reg).first()
    assert r["name"] == "Unknown" and r["enabled"] is False
    docs = spark.createDataFrame(
        [("1", "2024-01-01 00:00:00", "c", "green"), ("2", "2024-01-01 00:00:00", "c", "red"), ("3", "2023-12-01 00:00:00", "c", "yellow")],
        "_id string, timestamp string, cluster_id string, status string",
    ).withColumn("timestamp", F.to_timestamp("timestamp"))
    assert fleet.latest_cluster_status(docs).first()["status"] == "red"


def test_get_path_reads_null_where_the_schema_has_none(spark):
    from pyspark.sql import types as T

    from fleetlens.functions.nested import get_path

    df = spark.createDataFrame([((("x",), 3),), (None,)], T.StructType.fromDDL("a struct<b: struct<`1m`: string>, c: int>"))
    paths = ["a.b.1m", "a.c", "a.d", "a.c.e", "z"]
    got = [tuple(r) for r in df.select(*[get_path(df.schema, p).cast("string").alias(p) for p in paths]).collect()]
    assert got == [("x", "3", None, None, None), (None,) * 5]


def test_samples_without_an_index_write_and_read_back(spark, tmp_path):
    from fleetlens.sinks import writers

    empty = spark.createDataFrame([], "cluster_id string, index_name string, doc_rank int, _id string, _source string")
    path = str(tmp_path / "details")
    writers.write_index_details(empty, path)
    assert spark.read.schema(empty.schema).json(path).count() == 0
