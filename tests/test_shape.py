"""Masking, slimming, projection and flattening (FIXTURES §2.4, P1-P8)."""

import json

from pyspark.sql import functions as F

from fleetlens.functions.nested import flatten, project_paths, with_paths
from fleetlens.operators.shape import SlimConfig, flatten_json, mask_document, mask_ipv4, shape_documents, slim_document


def masked(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(mask_ipv4("t").alias("t")).first()["t"]


def test_mask_addresses(spark):
    cases = {
        "7.8.9.10": "*.*.9.10",
        "198.51.100.23": "*.*.100.23",
        "from 203.0.113.5:9300 to 203.0.113.250 lost": "from *.*.113.5:9300 to *.*.113.250 lost",
        "[node-4][198.51.100.4]": "[node-4][*.*.100.4]",
        "build9.8.7.6": "build9.8.7.6",  # no word boundary
        "7.8.9.10.11": "*.*.9.10.11",
        "1234.5.6.7": "1234.5.6.7",
        "8.1.2": "8.1.2",
    }
    for text, want in cases.items():
        assert masked(spark, text) == want


def test_mask_nested_and_idempotent(spark):
    df = spark.createDataFrame(
        [(("198.51.100.7", ["at 203.0.113.9", "plain"], 5, 0.5, False), {"198.51.100.8": "198.51.100.8"})],
        "s struct<host string, tags array<string>, n int, f double, b boolean>, m map<string,string>",
    )
    once = mask_document(df)
    r = once.first()
    assert r["s"]["host"] == "*.*.100.7" and r["s"]["tags"] == ["at *.*.113.9", "plain"]
    assert r["s"]["n"] == 5 and r["s"]["f"] == 0.5 and r["s"]["b"] is False
    assert r["m"] == {"198.51.100.8": "*.*.100.8"}  # keys stay
    assert mask_document(once).collect() == once.collect()


DOC = (
    "_id string, agent struct<id string>, metadata struct<name string, category string, datatype string, "
    "labels struct<cluster_id string>>, payload struct<indices struct<store struct<size_in_bytes long>, "
    "estimated_size string, limit_size string, list array<struct<store string, keep long>>>>"
)


def doc_frame(spark):
    return spark.createDataFrame(
        [("d1", ("a1",), ("node_stats", "es", "snap", ("c1",)), (((10,), "1kb", "2kb", [("x", 1)]),))], DOC
    )


def test_slim_both_parts(spark):
    out = slim_document(doc_frame(spark), SlimConfig(enabled=True))
    assert out.columns == ["metadata", "payload"]
    r = out.first().asDict(recursive=True)
    assert r["metadata"] == {"labels": {"cluster_id": "c1"}}
    # the object named store keeps its byte count; scalar human-readable keys go
    assert r["payload"]["indices"] == {"store": {"size_in_bytes": 10}, "list": [{"keep": 1}]}


def test_slim_switches(spark):
    only_meta = slim_document(doc_frame(spark), SlimConfig(enabled=True, remove_human_readable=False))
    assert "estimated_size" in only_meta.schema["payload"].dataType["indices"].dataType.names
    off = slim_document(doc_frame(spark), SlimConfig(enabled=False))
    assert off.columns == doc_frame(spark).columns


def test_project_paths_strict_and_subtree(spark):
    out = project_paths(doc_frame(spark), ["metadata.labels", "payload.indices.store.size_in_bytes", "nope"])
    r = out.first().asDict(recursive=True)
    assert r == {"metadata": {"labels": {"cluster_id": "c1"}}, "payload": {"indices": {"store": {"size_in_bytes": 10}}}}


def test_shape_order_mask_slim_project(spark):
    df = spark.createDataFrame([("d", ("10.1.2.3",))], "_id string, metadata struct<name string>")
    out = shape_documents(df, ["metadata"], mask=True, slim=SlimConfig(enabled=True))
    assert out.first().asDict(recursive=True) == {"metadata": {}} or out.columns == []


def test_with_paths_creates_parents(spark):
    df = spark.createDataFrame([((1,),)], "a struct<b long>")
    out = with_paths(df, {"a.c.d": F.lit(2), "e": F.lit("x")})
    assert out.first().asDict(recursive=True) == {"a": {"b": 1, "c": {"d": 2}}, "e": "x"}


def test_flatten_struct_and_json(spark):
    df = spark.createDataFrame([(((7, "green"),),)], "shard struct<state struct<id int, colour string>>")
    assert flatten(df).columns == ["shard.state.id", "shard.state.colour"]
    j = spark.createDataFrame([(1, '{"routing": {"tier": "hot", "seen": [1, {"x": 2}]}, "replicas": "1", "none": null}')], "id int, s string")
    want = {("routing.tier", "hot"), ("routing.seen", '[1,{"x":2}]'), ("replicas", "1"), ("none", "null")}
    assert {(r["key"], r["value"]) for r in flatten_json(j, ["id"], "s").collect()} == want
    assert {r["key"] for r in flatten_json(j, ["id"], "s", prefix="idx").collect()} == {f"idx.{k}" for k, _ in want}


FREE = {
    "at": "203.0.113.9:9300",
    "203.0.113.1": {"store": "5kb", "keep": [1, 2.5, None, True, "203.0.113.2"]},
    "store": {"limit_size": 3, "estimated_size": [], "n": "a \"store\": 1, b"},
    "rows": [{"store": None, "limit_size": "x"}, [{"store": 1, "z": "198.51.100.200"}], "text, {}"],
    "line": "one\n203.0.113.7\ttwo é",
}


def variant_frame(spark, *docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, j string")
    return df.select("id", F.parse_json("j").alias("doc"), F.struct(F.parse_json("j").alias("in")).alias("s"), F.array(F.parse_json("j")).alias("list"))


def read_back(df, column="doc"):
    return [None if r["j"] is None else json.loads(r["j"]) for r in df.orderBy("id").select(F.to_json(column).alias("j")).collect()]


def test_mask_variant(spark):
    out = mask_document(variant_frame(spark, FREE, "198.51.100.3", [], 5))
    want = {
        **FREE,
        "at": "*.*.113.9:9300",
        "203.0.113.1": {"store": "5kb", "keep": [1, 2.5, None, True, "*.*.113.2"]},
        "rows": [{"store": None, "limit_size": "x"}, [{"store": 1, "z": "*.*.100.200"}], "text, {}"],
        "line": "one\n*.*.113.7\ttwo é",
    }
    assert read_back(out) == [want, "*.*.100.3", [], 5]
    assert read_back(out, "s.in") == read_back(out)
    assert [x[0] for x in read_back(out, "list")] == read_back(out)


def test_slim_variant(spark):
    out = slim_document(variant_frame(spark, FREE), SlimConfig(enabled=True))
    want = {
        **FREE,
        "203.0.113.1": {"keep": FREE["203.0.113.1"]["keep"]},
        "store": {"estimated_size": [], "n": FREE["store"]["n"]},
        "rows": [{}, [{"z": "198.51.100.200"}], "text, {}"],
    }
    assert read_back(out) == [want]
    meta = variant_frame(spark, {"category": 1, "name": "n", "store": 4, "labels": {"name": "kept"}}).withColumnRenamed("doc", "metadata")
    assert read_back(slim_document(meta, SlimConfig(enabled=True)), "metadata") == [{"store": 4, "labels": {"name": "kept"}}]
    assert read_back(slim_document(meta, SlimConfig(enabled=True, remove_meta=False)), "metadata") == [{"category": 1, "name": "n", "labels": {"name": "kept"}}]


def test_project_variant(spark):
    df = variant_frame(spark, {"a": {"b": 1, "c": 2}, "l": [{"x": 1, "y": 2}, 3, {"z": 0}], "o": 1}, {"a": 5}, 7)
    out = project_paths(df, ["id", "doc.a.b", "doc.l.x", "doc.missing"])
    assert out.columns == ["id", "doc"]
    got = [None if r["j"] is None else json.loads(r["j"]) for r in out.orderBy("id").select(F.to_json("doc").alias("j")).collect()]
    assert got == [{"a": {"b": 1}, "l": [{"x": 1}, {}]}, {}, None]
    assert read_back(project_paths(df, ["id", "s.in.o", "s.in.a"]), "s.in")[0] == {"a": {"b": 1, "c": 2}, "o": 1}
    assert read_back(project_paths(df, ["id", "doc", "doc.a.b"]))[0]["o"] == 1  # the whole column wins
