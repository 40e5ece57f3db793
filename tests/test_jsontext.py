"""JSON text by tokens, against Python's json module."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.functions import arrays, jsontext

leaves = st.one_of(st.none(), st.booleans(), st.integers(-(10**9), 10**9), st.text(max_size=8).filter(lambda t: "\x00" not in t))
values = st.recursive(leaves, lambda v: st.one_of(st.lists(v, max_size=4), st.dictionaries(st.sampled_from(["a", "store", "é\\", 'q"', "x:y", "{"]), v, max_size=4)), max_leaves=25)


def run(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["o"] for r in df.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()]


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(values, min_size=40, max_size=60))
def test_pretty_and_drop(spark, docs):
    def dropped(v):
        if isinstance(v, dict):
            return {k: dropped(x) for k, x in v.items() if k != "store" or isinstance(x, (dict, list))}
        return [dropped(x) for x in v] if isinstance(v, list) else v

    texts = [json.dumps(d, ensure_ascii=False, separators=(",", ":")) for d in docs]
    assert run(spark, texts, jsontext.json_pretty) == [json.dumps(d, ensure_ascii=False, indent=2) for d in docs]
    spaced = [json.dumps(d, ensure_ascii=False, indent=1) for d in docs]
    assert run(spark, spaced, jsontext.json_pretty) == [json.dumps(d, ensure_ascii=False, indent=2) for d in docs]
    out = run(spark, texts, lambda t: jsontext.drop_scalar_members(t, ["store"]))
    assert [json.loads(o) for o in out] == [dropped(d) for d in docs]
    upper = run(spark, texts, lambda t: jsontext.map_json_strings(t, lambda c: F.replace(c, F.lit("a"), F.lit("A")), "a"))
    assert [json.loads(o) for o in upper] == [mapped(d) for d in docs]


def mapped(v):
    if isinstance(v, dict):
        return {k: mapped(x) for k, x in v.items()}
    if isinstance(v, list):
        return [mapped(x) for x in v]
    return v.replace("a", "A") if isinstance(v, str) else v


def test_layout(spark):
    bad = ["", "{", "{'a':1}", None]
    assert run(spark, bad, jsontext.json_pretty) == [None] * 4
    assert run(spark, ["[ ]", '{"a":{}}', '[[1],"x"]'], jsontext.json_pretty) == ["[]", '{\n  "a": {}\n}', '[\n  [\n    1\n  ],\n  "x"\n]']


def test_deep_and_long(spark):
    deep = "[" * 400 + "]" * 400
    long = json.dumps([{"k": i, "store": str(i)} for i in range(20_000)], separators=(",", ":"))
    out = run(spark, [deep, long], jsontext.json_pretty)
    assert out == [json.dumps(json.loads(t), indent=2) for t in (deep, long)]
    assert json.loads(run(spark, [long], lambda t: jsontext.drop_scalar_members(t, ["store"]))[0]) == [{"k": i} for i in range(20_000)]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 2000])
def test_running(spark, n):
    xs = [(i * 37) % 11 - 5 for i in range(n)]
    df = spark.createDataFrame([(xs,)], "x array<int>")
    r = df.select(arrays.sums_before(F.col("x")).alias("s"), arrays.most_before(F.col("x")).alias("m")).first()
    assert r["s"] == [sum(xs[:i]) for i in range(n)] and r["m"] == [max([-1, *xs[:i]]) for i in range(n)]
