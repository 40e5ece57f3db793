"""Request files by lines, stored sketches, the bucketed store."""

import contextlib
import io
import os
import random
import uuid
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import functions as F

from fleetlens.operators import estimate, requests, sampling
from fleetlens.session import write_shared
from fleetlens.sources import adaptors, store

UTC = timezone.utc


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def log_text(rnd, titles):
    out = rnd.choice(["", "\n \n", "stray\n"])
    for i in range(titles):
        out += rnd.choice(["# T", "  ## T", "#"]) + f" {i}\n" * rnd.randint(0, 1) + "\n" * rnd.randint(0, 2)
        out += rnd.choice(["GET a/_search\n{\"size\":1}\n", "POST b/_msearch\n{}\n\n{\"q\":[]}\n", "", "???\n", "get c\n{\"x\": \n"]) + "\n" * rnd.randint(0, 3)
    return out


def test_logs_cut_anywhere_give_the_same_cases(spark, tmp_dir):
    rnd = random.Random(8)
    texts = {f"f{i}.txt": log_text(rnd, rnd.randint(0, 40)) for i in range(12)}
    os.makedirs(f"{tmp_dir}/logs")
    for name, text in texts.items():
        with open(f"{tmp_dir}/logs/{name}", "w", encoding="utf-8", newline="") as f:
            f.write(text.replace("\n", "\r\n") if name == "f3.txt" else text)
    whole = spark.createDataFrame([(n, t) for n, t in texts.items()], "file_id string, text string")
    want = sorted(map(str, requests.parse_requests(whole).collect()))
    for size in ("100", "37", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            cases = requests.read_request_logs(spark, f"{tmp_dir}/logs")
            parsed = requests.parse_requests(cases, number_col="number").withColumn("file_id", F.regexp_extract("file_id", "([^/]+)$", 1))
            assert sorted(map(str, parsed.collect())) == want
            parts = spark.read.text(f"{tmp_dir}/logs").rdd.getNumPartitions()
            assert parts > 20 if size != "100000" else parts < 20
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pieces_do_not_depend_on_batches():
    rnd = random.Random(12)
    rows = [(f"f{f}", p, rnd.random() < 0.2, rnd.choice(["", "x", "# t"])) for f in range(9) for p in (0, 50, 90)[: rnd.randint(1, 3)] for _ in range(rnd.randint(1, 30))]
    want, own = {}, 0
    for i, (f, p, title, line) in enumerate(rows):
        own = title + (own if i and rows[i - 1][:2] == (f, p) else 0)
        want.setdefault((f, p, own), []).append(line)
    names = ["file_id", "part", "title", "line"]
    for size in (1, 2, 7, 40, len(rows)):
        cut = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[a : a + size]]) for a in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in requests._pieces(iter([cut[0].slice(0, 0), *cut])) for r in b.to_pylist()]
        assert got == [(*k, "\n".join(v)) for k, v in want.items()]


def test_logs_shuffle_the_edges_of_parts_alone(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/logs")
    with open(f"{tmp_dir}/logs/a", "w", encoding="utf-8") as f:
        f.write("# T\nGET a\n" * 500)
    cases = requests.read_request_logs(spark, f"{tmp_dir}/logs")
    assert cases.count() == 500
    shown = plan(cases)
    assert shown.count("Exchange hashpartitioning") == 1 and "Window" not in shown and "own" in shown


def test_written_logs_hold_the_orders_texts(spark, tmp_dir):
    rows = [(k, k % 9, "FOP"[k % 3], f"{k % 5 + 1}-X") for k in range(300)] + [(None, 1, "F", "1-X"), (7, 1, None, "1-X"), (7, None, "O", None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_dir}/orders.parquet")
    written = spark.read.text(adaptors.request_logs(spark, tmp_dir))
    texts = adaptors.request_files(spark, tmp_dir, preambles=False).select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")), (F.col("file_id") % 64).cast("int"))
    assert sorted(map(tuple, written.collect()), key=repr) == sorted(map(tuple, texts.collect()), key=repr)
    one = adaptors.request_logs(spark, tmp_dir)
    log = spark.read.text(f"{one}/log=5").collect()
    assert [r.value for r in log if r.value.startswith("# Count ")] == [f"# Count {'FOP'[k % 3]}" for k in range(5, 300, 64)]


def documents(spark, rnd, n):
    t0 = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(str(i), t0 + timedelta(minutes=rnd.randrange(0, 6000)), rnd.choice(["c1", "c1", "c2", None]), f"n{rnd.randrange(40)}", rnd.choice([None, rnd.randrange(1000)]), rnd.choice([None, rnd.randrange(1000)])) for i in range(n)]
    return spark.createDataFrame(rows, "_id string, timestamp timestamp, c string, n string, cnt long, tm long")


def test_sketches_answer_later_windows(spark):
    df = documents(spark, random.Random(9), 900)
    stored = write_shared(estimate.group_sketches(df, ["c"], ["c", "n"]), "sketches")
    for first, last in ((1, 5), (2, 3)):
        lo, hi = datetime(2024, 1, first, 5, tzinfo=UTC), datetime(2024, 1, last, 1, tzinfo=UTC)
        out = estimate.estimate_from_sketches(stored, ["c"], "1h", lo, hi)
        assert all("sketches" in f for f in out.inputFiles())  # no document is read
        day = F.dayofmonth("timestamp")
        exact = {r["c"]: (r["rows"], r["g"]) for r in df.where(day.between(first, last)).groupBy("c").agg(F.count("*").alias("rows"), F.countDistinct("n").alias("g")).collect()}
        got = {r["c"]: r for r in out.collect()}
        assert {c: (r["rows"], r["groups"]) for c, r in got.items()} == exact
        assert all(r["buckets"] == 24 * (last - first + 1) and r["estimate"] == min(r["rows"], r["groups"] * r["buckets"]) for r in got.values())


def test_store_samples_without_exchange(spark, tmp_dir):
    df = documents(spark, random.Random(10), 700)
    name = f"store_{uuid.uuid4().hex}"
    store.write_metric_store(df, name, ["c", "n"], 4, path=f"{tmp_dir}/{name}")
    rules = sampling.FieldRules(rate=("cnt",), latency={"lat": ("tm", "cnt")}, max=("tm",))
    stored = store.read_metric_store(spark, name)
    for interval in ("15m", "6h", "1d", "7h", "2d"):
        for drop in (True, False):
            got = store.sample_store(stored, ["c", "n"], interval, rules, drop_null_groups=drop)
            want = sampling.sample_buckets(df, ["c", "n"], interval, rules, drop_null_groups=drop)
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in plan(store.sample_store(stored, ["c", "n"], "15m", sampling.FieldRules(max=("tm",))))
    assert "Exchange" in plan(sampling.sample_buckets(df, ["c", "n"], "15m", sampling.FieldRules(max=("tm",))))
    part = store.read_metric_store(spark, name, "2024-1-2", "2024-01-03")
    assert part.count() == df.where(F.dayofmonth("timestamp").between(2, 3)).count()
    assert "PartitionFilters: [isnotnull(day" in plan(part)
    spark.sql(f"DROP TABLE {name}")
