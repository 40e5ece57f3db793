"""Request-file parsing, targets, aliases and overview."""

from pyspark.sql import functions as F

from fleetlens.operators import requests

TEXT = """
# Search movies
GET movies/_search
{"query": {"match_all": {}}}

## 
post index1, index2/_msearch
{"index": "a"}
{"query": {}}

#   Broken
GET movies/_search
{"query": 

# No method

# Bad method
???

# Cat
GET /_cat/indices?v
"""


def test_parse(spark):
    files = spark.createDataFrame([("f1", TEXT)], "file_id string, text string")
    rows = {r["seq"]: r for r in requests.parse_requests(files).collect()}
    assert rows[1]["title"] == "Search movies" and rows[1]["method"] == "GET" and rows[1]["path"] == "movies/_search"
    assert rows[1]["body_raw"] == '{"query": {"match_all": {}}}' and rows[1]["body_valid"] is True and rows[1]["error"] is None
    assert rows[2]["title"] == "Query 2" and rows[2]["method"] == "POST" and rows[2]["body_is_ndjson"] is True
    assert rows[2]["body_sent"] == '{"index": "a"}\n{"query": {}}\n'
    assert rows[3]["title"] == "Broken" and rows[3]["error"] == requests.ERR_BAD_JSON
    assert rows[4]["error"] == requests.ERR_NO_METHOD
    assert rows[5]["error"] == requests.ERR_BAD_METHOD
    assert rows[6]["body_raw"] == "" and rows[6]["error"] is None
    bad = spark.createDataFrame([("f2", "GET x\n# T\nGET y\n")], "file_id string, text string")
    errs = {r["seq"]: r["error"] for r in requests.parse_requests(bad).collect()}
    assert errs == {0: requests.ERR_PREAMBLE, 1: None}


def test_targets_aliases_overview(spark):
    files = spark.createDataFrame([("f1", TEXT)], "file_id string, text string")
    cases = requests.parse_requests(files)
    t = requests.request_targets(cases)
    got = sorted((r["seq"], r["target_pos"], r["target"]) for r in t.collect())
    assert got == [(1, 0, "movies"), (2, 0, "index1"), (2, 1, "index2")]
    aliases = spark.createDataFrame([("movies", "movies-v2"), ("movies", "movies-v1"), ("index2", "index1")], "alias string, index string")
    r = requests.resolve_aliases(t, aliases)
    got = sorted((x["seq"], x["resolved_pos"], x["index_name"]) for x in r.collect())
    assert got == [(1, 1, "movies-v1"), (1, 2, "movies-v2"), (2, 1, "index1")]
    ov = spark.createDataFrame([("movies-v1", "green", "8516", "1mb")], "index string, health string, docs_count string, store_size string")
    o = {x["index_name"]: x for x in requests.index_overview(r, ov).collect()}
    assert o["movies-v1"]["docs_count"] == "8,516" and o["movies-v2"]["health"] == "-" and o["movies-v2"]["docs_count"] == "-"
    facts = spark.createDataFrame([("movies-v1", "{m}", "{s}")], "index string, mapping string, settings string")
    rep = {x["index_name"]: (x["mapping"], x["settings"], x["pri"]) for x in requests.index_report(r, ov, facts, facts).collect()}
    assert rep == {"movies-v1": ("{m}", "{s}", "-"), "movies-v2": (None, None, "-"), "index1": (None, None, "-")}


def test_cases_are_dealt_out_by_their_rows(spark, monkeypatch):
    """The rows that a task sorts are bounded, whatever their shuffled bytes."""
    monkeypatch.setattr(requests, "TASK_ROWS", 100)
    rows = [(f, s, p, f"t{(s + p) % 3}") for f in range(150) for s in (1, 2) for p in (0, 1)]
    targets = spark.createDataFrame(rows, "file_id long, seq int, target_pos int, target string")
    aliases = spark.createDataFrame([("t1", "i1"), ("t1", "t2")], "alias string, index string")
    got = requests.resolve_aliases(targets, aliases)
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) < 200
    of = {0: ["t0"], 1: ["i1", "t2"], 2: ["t2"]}
    want = []
    for f in range(150):
        for s in (1, 2):
            names = list(dict.fromkeys([*of[s % 3], *of[(s + 1) % 3]]))
            want += [(f, s, n, i + 1) for i, n in enumerate(names)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
