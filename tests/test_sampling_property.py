"""Property: the sampler equals a brute-force model of the documented rules
on random series (nulls, counter resets, gaps, ties on time)."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st

from fleetlens.operators.sampling import FieldRules, sample_buckets

T0 = datetime(2024, 1, 1)
INTERVAL_S = 900

docs = st.lists(
    st.tuples(
        st.sampled_from(["n1", "n2"]),
        st.integers(min_value=0, max_value=180),  # minutes from T0
        st.one_of(st.none(), st.integers(min_value=0, max_value=5000)),  # counter
        st.one_of(st.none(), st.integers(min_value=0, max_value=5000)),  # time
    ),
    min_size=1,
    max_size=25,
)


def model(rows):
    """Newest doc per (node, bucket) by (time, id); then rate and latency over
    the previous values in bucket order: a rate since the counter's last value,
    a latency since the last bucket that held both its inputs."""
    latest = {}
    for i, (node, minute, count, tm) in enumerate(rows):
        bucket = (minute * 60 // INTERVAL_S) * INTERVAL_S
        key = (node, bucket)
        cand = (minute, f"{i:03d}", count, tm)
        if key not in latest or cand[:2] > latest[key][:2]:
            latest[key] = cand
    out = {}
    prev = {}
    for (node, bucket) in sorted(latest):
        _m, _id, count, tm = latest[(node, bucket)]
        p = prev.setdefault(node, {"c": None, "pair": None})
        rate = None
        if count is not None:
            if p["c"] is None:
                rate = float(count)
            else:
                d = count - p["c"]
                rate = (count if d < 0 else d) / INTERVAL_S
        lat = None
        if count is not None and tm is not None:
            if p["pair"] is not None:
                before_c, before_t = p["pair"]
                dc = count if count < before_c else count - before_c
                dt = tm if tm < before_t else tm - before_t
                lat = 0.0 if dc == 0 else dt / dc
            p["pair"] = (count, tm)
        if count is not None:
            p["c"] = float(count)
        out[(node, bucket * 1000 + int(T0.timestamp()) * 1000)] = (_id, rate, lat)
    return out


def agrees(got, want):
    if got is None or want is None:
        return got is None and want is None
    return abs(got - want) < 1e-9


def sampled(spark, rows, **options):
    data = [(f"{i:03d}", T0 + timedelta(minutes=m), n, c, t) for i, (n, m, c, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "_id string, timestamp timestamp, node string, cnt long, tm long")
    rules = FieldRules(rate=("cnt",), latency={"lat": ("tm", "cnt")})
    return {(r["node"], r["bucket_ms"]): (r["_id"], r["cnt"], r["lat"]) for r in sample_buckets(df, ["node"], "15m", rules, **options).collect()}


@settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@example(rows=[("n2", 15, None, 0), ("n2", 0, 0, 1), ("n2", 30, 1, 1)])
@example(rows=[("n2", 0, 0, None), ("n2", 15, None, 0), ("n2", 30, 0, 0)])
@given(rows=docs)
def test_sampler_matches_model(spark, rows):
    got, want = sampled(spark, rows), model(rows)
    assert set(got) == set(want)
    for k, (wid, wrate, wlat) in want.items():
        gid, grate, glat = got[k]
        assert gid == wid and agrees(grate, wrate) and agrees(glat, wlat)


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@example(rows=[("n1", 0, 5, 1), ("n1", 180, 9, 3)], block=1)  # empty blocks between
@example(rows=[("n1", 0, 5, None), ("n1", 20, None, 3), ("n1", 40, None, None), ("n1", 70, 4, 9)], block=2)
@given(rows=docs, block=st.integers(min_value=1, max_value=5))
def test_any_cut_into_blocks_gives_the_same_rows(spark, rows, block):
    assert sampled(spark, rows, carry_block=block) == sampled(spark, rows)


@pytest.mark.parametrize("drop", [True, False])
def test_blocks_of_null_series(spark, drop):
    rows = [(None, m, m * 3, m) for m in range(0, 180, 7)] + [("n1", m, m, None if m % 3 else m) for m in range(0, 180, 10)]
    assert sampled(spark, rows, carry_block=2, drop_null_groups=drop) == sampled(spark, rows, drop_null_groups=drop)
