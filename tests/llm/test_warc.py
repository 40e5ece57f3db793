"""WARC round trip and the splittable reader."""

import hashlib
import os
import random

import pytest

from fleetlens.llm import warc as W

DATE = "2024-01-02T03:04:05Z"
SCHEMA = "page_id long, url string, html string, payload string, digest string, salt int"


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "", "", 0) for i, u, h in rows], SCHEMA)
    return W.round_trip(spark, df)


def test_round_trip(spark):
    big = "<p>é" + "x" * 300_000
    rows = [(i, f"http://a/{i}", f"<html>{i % 7}" + "y" * 120) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nX: 1 é", ""), (102, "u", "short"), (103, "u", "short"), (104, "u", big), (90, "u", big)]
    got = {r.page_id: r for r in run(spark, rows).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        first = min(j for j, _, g in rows if (g or "") == (h or ""))
        again = first < i and len(data) >= 100
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))
        assert r.payload == (None if again else data)
    assert got[101].uri == "u%0D%0AX:%201%20é"


def test_repeated_rows_null_ids_and_empty_table(spark):
    page = "z" * 200
    got = run(spark, [(4, "u", page), (4, "u", page), (7, "u", page), (None, "u", page)]).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (4, "response", 0), (4, "response", 0), (7, "revisit", 4)]
    assert run(spark, []).count() == 0


@pytest.mark.parametrize("step", [64, 1000, 20_000])
def test_small_ranges_find_every_record_once(spark, step):
    rnd = random.Random(step)
    rows = [(i, "u", "".join(rnd.choice("ab<>") for _ in range(rnd.randint(0, 400)))) for i in range(80)]
    from fleetlens.session import fresh_folder

    manifest = W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), fresh_folder(spark, "t"))
    assert {m.path.rsplit(".", 2)[1] for m in manifest.collect()} == {"warc"}
    got = W.read_archives(spark, manifest, range_bytes=step).collect()
    assert sorted(r.page_id for r in got) == list(range(80))
    assert {r.page_id: (r.payload or b"").decode() for r in got if r.record_type == "response"} == {i: h for i, _, h in rows if not any(g == h and j < i and len(h) >= 100 for j, _, g in rows)}


def test_magic_inside_members_is_no_record(tmp_path):
    rnd = random.Random(3)
    path, records = str(tmp_path / "a.warc.gz"), []
    with open(path, "wb") as f:
        for i in range(120):
            payload = W.MAGIC * rnd.randint(0, 60) + os.urandom(rnd.randint(0, 1500))
            records.append((f.tell(), payload))
            f.write(W.gzip_member(W.record_bytes(i, "u", payload, hashlib.sha256(payload).hexdigest(), None, DATE), level=0))
    size = os.path.getsize(path)
    system, inside = W.file_system(path)
    for step in (97, 1500, size):
        with system.open_input_file(inside) as source:
            got = [(o, W._row(d)["payload"]) for a in range(0, size, step) for o, d in W.records_in(source, a, min(a + step, size), size)]
        assert got == records


def test_records_have_the_mandatory_headers(spark):
    from fleetlens.session import fresh_folder

    pages = spark.createDataFrame([(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200)], "page_id long, url string, html string")
    found = []
    for m in W.write_archives(pages, fresh_folder(spark, "t"), date=DATE).collect():
        system, path = W.file_system(m.path)
        with system.open_input_file(path) as source:
            found += [W.parse_record(d) for _, d in W.records_in(source, 0, m.length, m.length)]
    assert sorted(r["WARC-Type"] for r in found) == ["response", "revisit"]
    for r in found:
        assert r["WARC-Date"] == DATE and r["Content-Type"] == "application/http; msgtype=response" and r["http"]["Content-Length"] == "200"
        assert r["body"] == (b"x" * 200 if r["WARC-Type"] == "response" else b"")


def test_malformed_members_are_reported_and_the_rest_is_read(spark, tmp_path):
    body = b"<p>" + b"y" * 300
    good = W.record_bytes(5, "u", body, hashlib.sha256(body).hexdigest(), None, DATE)
    bad = [
        good.replace(b"Content-Length: ", b"Length: "),
        good.replace(b"WARC-Date", b"Date"),
        good.replace(b"yyy", b"zzz", 1),  # digest
        good[:-9],
        W.VERSION + b"\r\n\r\n",
        good.replace(b"WARC-Type: response", b"WARC-Type: metadata"),
    ]
    path, offsets = str(tmp_path / "m.warc.gz"), []
    with open(path, "wb") as f:
        f.write(W.gzip_member(b"no record at all"))
        for data in [good, *bad]:
            offsets.append(f.tell())
            f.write(W.gzip_member(data))
        offsets.append(f.tell())
        f.write(W.gzip_member(good)[:-30])  # cut short
    manifest = spark.createDataFrame([(path, os.path.getsize(path))], "path string, length long")
    got = {r.offset: r for r in W.read_archives(spark, manifest, range_bytes=100).collect()}
    assert sorted(got) == offsets
    assert [got[o].record_type for o in offsets] == ["response", "malformed", "malformed", "malformed", "malformed", "malformed", "metadata", "malformed"]
    assert got[offsets[0]].payload == body and all(got[o].payload is None and got[o].page_id is None for o in offsets[1:])


def test_a_large_record_is_read_in_linear_time(tmp_path):
    import time

    took = []
    for size in (8, 32):
        body = os.urandom(size << 20)
        path = str(tmp_path / f"{size}.warc.gz")
        with open(path, "wb") as f:
            f.write(W.gzip_member(W.record_bytes(1, "u", body, hashlib.sha256(body).hexdigest(), None, DATE), level=1))
        length = os.path.getsize(path)
        began = time.process_time()
        with open(path, "rb") as f:
            import pyarrow as pa

            [(_, data)] = list(W.records_in(pa.PythonFile(f), 0, length, length))
        took.append(time.process_time() - began)
        assert W._row(data)["payload"] == body
    assert took[1] < 10 * took[0] + 1
