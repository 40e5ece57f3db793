"""Fleet report, summary, health distribution, name lookup, catalog (FIXTURES §2.5, §2.7)."""

from pyspark.sql import functions as F

from fleetlens.operators import catalog, fleet, joins

REG = "id string, name string, version string, enabled boolean, monitored boolean"
STATUS = (
    "cluster_id string, available boolean, health struct<status string, number_of_nodes long, "
    "active_primary_shards long, active_shards long, unassigned_shards long>"
)
SUMMARY = (
    "cluster_id string, cluster_name string, status string, version array<string>, uptime long, nodes_count long, "
    "indices_count long, primary_shards long, total_shards long, unassigned_shards long, document_count long, "
    "used_store_bytes long, max_store_bytes long, used_jvm_bytes long, max_jvm_bytes long"
)


def report(spark, reg, status, summary, **kw):
    return fleet.fleet_report(
        spark.createDataFrame(reg, REG), spark.createDataFrame(status, STATUS), spark.createDataFrame(summary, SUMMARY),
        system_ids=["sys-id"], system_name_words=["CONSOLE-SYSTEM"], **kw,
    )


def test_summary_two_clusters(spark):
    reg = [("c1", "one", "7.1", True, True), ("c2", "two", "7.2", True, False)]
    status = [("c1", True, ("green", 3, 1, 2, 0)), ("c2", False, ("green", 1, 1, 1, 0))]
    summary = [
        ("c1", None, None, ["8.1"], 65000, 3, 10, 5, 10, 0, 1000, 1024, 2048, 10, 30),
        ("c2", None, None, None, 0, 0, 5, 0, 0, 0, 500, 0, 0, 0, 0),
    ]
    r = report(spark, reg, status, summary)
    rows = {x["cluster_id"]: x for x in r.collect()}
    assert rows["c1"]["version"] == "8.1" and rows["c2"]["version"] == "7.2"
    assert rows["c1"]["uptime"] == "1m 5s" and rows["c2"]["uptime"] == "Unknown"
    assert rows["c2"]["nodes_count"] == 1  # summary 0 falls through to health
    assert rows["c1"]["jvm_used_percent"] == 33.33 and rows["c2"]["jvm_used_percent"] == 0.0
    assert rows["c1"]["storage_used_formatted"] == "1.00 KB"
    s = fleet.fleet_summary(r).first()
    assert (s["total_clusters"], s["available_clusters"], s["monitored_clusters"]) == (2, 1, 1)
    assert (s["total_nodes"], s["total_indices"], s["total_documents"]) == (4, 15, 1500)


def test_health_distribution(spark):
    reg = [(f"c{i}", f"n{i}", "7", True, True) for i in range(4)]
    status = [(f"c{i}", True, (st, 1, 1, 1, 0)) for i, st in enumerate(["green", "green", "yellow", "red"])]
    r = report(spark, reg, status, [])
    got = {x["health_status"]: x["clusters"] for x in fleet.health_distribution(r).collect()}
    assert got == {"green": 2, "yellow": 1, "red": 1}


def test_empty_and_system_clusters(spark):
    assert report(spark, [], [], []).count() == 0
    reg = [("c1", "normal", "7", True, True), ("c2", "my console-system cluster", "7", True, True), ("sys-id", "x", "7", True, True)]
    assert report(spark, reg, [], []).count() == 1
    assert report(spark, reg, [], [], include_system=True).count() == 3


def test_resolve_names(spark):
    reg = spark.createDataFrame([("1", "Alpha"), ("2", "alpha"), ("3", "Beta-prod"), ("4", "Gamma")], "id string, name string")
    req = spark.createDataFrame([("Alpha",), ("ALPHA",), ("prod",), ("a",), ("zzz",), ("gamma",)], "name string")
    got = {r["name"]: (r["cluster_id"], r["match_type"], r["status"]) for r in fleet.resolve_cluster_names(req, reg).collect()}
    assert got["Alpha"] == ("1", "exact", "ok")
    assert got["ALPHA"] == (None, "case_insensitive", "ambiguous")
    assert got["prod"] == ("3", "substring", "ok")
    assert got["a"][2] == "ambiguous"
    assert got["zzz"] == (None, None, "not_found")
    assert got["gamma"] == ("4", "case_insensitive", "ok")


def test_resolve_equals_search_of_all_names(spark, monkeypatch):
    """Names that share almost every piece, requests of every length; pieces split."""
    monkeypatch.setattr(fleet, "NAMES_PER_TASK", 7)
    names = [f"search-prod-{i:04d}" for i in range(120)] + ["a", "AB", "ab", "é1", "prod"]
    reg = [(str(i), n) for i, n in enumerate(names)] + [("x", None), (None, "prod-9"), ("y", "  ")]
    req = ["search", "prod-00", "-0119", "00", "9", "b", "e", "É1", "ab", "search-prod-0007", "SEARCH-PROD-0008", "0120", "zz", "prod-011", "rch-prod-0", " "]
    got = {r["name"]: (r["cluster_id"], r["match_type"], r["candidates"]) for r in fleet.resolve_cluster_names(spark.createDataFrame([(r,) for r in req], "name string"), spark.createDataFrame(reg, "id string, name string")).collect()}
    good = [(i, n.strip()) for i, n in reg if i and n and n.strip()]
    want = {}
    for r in {r.strip() for r in req} - {""}:
        kinds = (
            ("exact", [i for i, n in good if n == r]),
            ("case_insensitive", [i for i, n in good if n.lower() == r.lower()]),
            ("substring", [i for i, n in good if r.lower() in n.lower()]),
        )
        kind, ids = next(((k, i) for k, i in kinds if i), (None, []))
        want[r] = (ids[0] if len(ids) == 1 else None, kind, len(ids))
    assert got == want


def test_lookup_join_broadcast_or_salted(spark):
    facts = spark.range(50).select(F.lit("k").alias("key"), F.col("id"), F.parse_json(F.lit("{}")).alias("v"), F.create_map(F.lit("a"), "id").alias("m"))
    lookup = spark.createDataFrame([("k", 1), ("k", 2), ("z", 3)], "key string, x int")
    for how in ("left", "inner"):
        small, large = (joins.lookup_join(facts.union(facts.withColumn("key", F.lit("none"))), lookup, "key", how, limit=n) for n in (10**9, 0))
        assert sorted((r["key"], r["id"], r["x"] or 0) for r in small.collect()) == sorted((r["key"], r["id"], r["x"] or 0) for r in large.collect())
        assert small.count() == 100 + (50 if how == "left" else 0)


def test_active_clusters_mode_name(spark):
    m = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c1", "b"), ("c2", None)], "cluster_id string, cluster_name string")
    got = [(r["cluster_id"], r["cluster_name"], r["doc_count"]) for r in fleet.active_clusters(m).collect()]
    assert got == [("c1", "b", 3), ("c2", "c2", 1)]


def test_catalog_rules(spark):
    reg = spark.createDataFrame([("c1", "one"), ("c2", "two"), ("c3", "three")], "id string, name string")
    status = spark.createDataFrame([("c1", True), ("c2", False)], "cluster_id string, available boolean")
    cat = spark.createDataFrame(
        [("c1", "a", "green", "42"), ("c1", ".sys", "green", "1"), ("c1", "b", "UNAVAILABLE", "5"), ("c1", "c", "yellow", "invalid"),
         ("c1", "d", None, "7"), ("c2", "x", "green", "1"), ("c3", "y", "green", "1")],
        "cluster_id string, index string, health string, docs_count string",
    )
    idx = catalog.eligible_indices(reg, status, cat, max_indices=2)
    got = {(r["index_name"], r["doc_count"]) for r in idx.collect()}
    assert got == {("a", 42), ("c", 0)}
    everything = catalog.eligible_indices(reg, status, cat, include_system=True)
    assert {r["index_name"] for r in everything.collect()} == {".sys", "a", "c", "d"}
    docs = spark.createDataFrame(
        [("c1", "a", str(i), i, "{}") for i in range(5)], "cluster_id string, index string, _id string, seq long, _source string"
    )
    s = catalog.sample_documents(idx, docs, sample_size=2)
    assert sorted(r["_id"] for r in s.collect()) == ["0", "1"]
    nested = catalog.index_samples(idx, s).where(F.col("index_name") == "a").first()
    assert [d["_id"] for d in nested["sample_docs"]] == ["0", "1"]
