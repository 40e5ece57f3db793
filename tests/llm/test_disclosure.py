"""Personal data and the terms that disclose it, against plain Python."""

import random
import re

import duckdb
import pytest

from fleetlens.llm import disclosure as D
from fleetlens.llm import queries
from fleetlens.llm.oracle import SQL
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, spans string, v int, term string, _text int"
SPACE = " \t\n\x0b\x0c\r"
# the definition itself, without the guards against slow runs
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        odd = sum(int(d) for d in digits[::-2])
        even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
        return 14 <= len(digits) <= 19 and (odd + even) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    out = []
    for ord_, (kind, pattern) in enumerate(BASE.items()):
        found = list(re.finditer(pattern, text))
        for k, m in enumerate(found):
            if good(kind, m.group()):
                low = found[k - 1].end() if k else 0
                high = found[k + 1].start() if k + 1 < len(found) else len(text)
                entity = m.group().lower() if kind == "email" else m.group() if kind == "ip" else re.sub("[^0-9]", "", m.group())
                out.append((m.start(), ord_, kind, m.end(), (kind, entity), low, high))
    return out


def word_term(word):
    m = re.fullmatch(r"[^\w]*([^\W\d_]{4,})[^\w]*", word.replace("_", "-"))
    return m and m.group(1).lower()


def terms_of(text):
    return [(m.start() + re.match(r"[\W_]*", m.group()).end(), word_term(m.group())) for m in re.finditer(rf"[^{SPACE}]+", text) if word_term(m.group())]


def around(text, start, stop, low, high):
    """Whole words within 48 characters that do not touch the match."""
    left, right = max(low, start - 48), min(high, stop + 48)
    out = []
    for a, b, cut_left, cut_right in ((left, start, left > low, True), (stop, right, True, right < high)):
        for m in re.finditer(rf"[^{SPACE}]+", text[a:b]):
            if not (cut_left and m.start() == 0) and not (cut_right and m.end() == b - a):
                out.append(word_term(m.group()))
    return {t for t in out if t}


def brute(rows):
    texts = {t or "" for _, t in rows}
    n_all = len({t for _, t in rows})
    holds, pair, entity = {}, {}, {}
    for t in texts:
        for _, w in terms_of(t):
            holds.setdefault(w, set()).add(t)
        for start, _, _, stop, e, low, high in base_spans(t):
            entity.setdefault(e, set()).add(t)
            for w in around(t, start, stop, low, high):
                pair.setdefault((w, e), set()).add(t)
    kind = {}
    for (w, e), ts in pair.items():
        if len(ts) >= 2 and 16 * len(entity[e]) <= n_all and 4 * len(ts) >= len(holds[w]):
            if 2 * len(ts) >= len(holds[w]) or kind.get(w) == "reveals":
                kind[w] = "reveals"
            else:
                kind[w] = "hints"
    out = []
    for i, t in rows:
        s = [(a, o, k, b) for a, o, k, b, *_ in base_spans(t or "")]
        s += [(a, 4 if kind[w] == "reveals" else 5, kind[w], a + len(w)) for a, w in terms_of(t or "") if w in kind]
        out.append((i, sorted(s)))
    return out


def corpus():
    rnd = random.Random(4)
    common = ["alpha", "beta", "gamma", "delta", "omega", "é" * 5, "of", "w1ord", "sigma,", "(kappa)"]
    people = [(f"p{k}.x_{k}@mail{k % 3}.example.com", f"nick{'abcdefghij'[k]}", f"+1 (386) 555-37{k}3", f"4.{k}.255.0{k}", "4041894974608795") for k in range(10)]
    rows = []
    for i in range(260):
        words = [rnd.choice(common) + rnd.choice(["", ".", "\n"]) for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            mail, nick, phone, ip, card = rnd.choice(people)
            at = rnd.randint(0, len(words))
            words[at:at] = rnd.choice([[mail, f"Owner{nick},", phone], [f"by {nick}", ip, card], [f"<{mail}>{nick}"], [phone, mail, ip, f"({nick})"]])
        if i % 11 == 0:
            words.append(f"nick{'abcdefghij'[i % 10]}")
        if i % 24 == 1:
            words.append("nickb")
        rows.append((i, " ".join(words)))
    rows += [(i + 1000, t) for i, t in rows[:40]]  # exact copies
    tricky = ["a@b.c_d@e.f", "x@y.z.w-", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "+1 +12345678901 +1 23 (4)-", "4111 1111 1111 1111-4111111111111111", "@.@ a@b", "4041894974608795+1 234 567 8901", "..@a.b 1@1.1.1.1"]
    rows += [(2000 + k, t) for k, t in enumerate(tricky)]
    return [*rows, (3000, None), (3001, ""), (None, "p0.x_0@mail0.example.com nicka"), (3002, "nicka"), (3002, "nickb 1.1.1.1"), (3002, "nickb 1.1.1.1")]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "", 0, "", 0) for i, t in corpus()], SCHEMA)
    return docs, *D.find_personal(docs)


def test_equals_plain_python(found):
    _, rows, terms = found
    got = sorted(((r["id"], [tuple(s) for s in r["spans"]]) for r in rows.collect()), key=repr)
    assert got == sorted(brute(corpus()), key=repr)
    kinds = [r["kind"] for r in terms.collect()]
    assert "reveals" in kinds and "hints" in kinds


def test_sanitise(found):
    docs, rows, _ = found
    out = D.sanitise(docs, rows)
    assert out.columns == docs.columns
    want = []
    for (i, t), (_, s) in zip(corpus(), brute(corpus()), strict=True):
        text, end = "", 0
        for a, _, kind, b in s:
            if a >= end:
                text += t[end:a] + {"reveals": "", "hints": "[TERM]"}.get(kind, f"[{kind.upper()}]")
            end = max(end, b)
        want.append((i, t if t is None else text + t[end:]))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_query_equals_sql_with_terms(spark, tmp_path):
    rows = [(i, t) for k, (i, t) in enumerate(corpus()) if i is not None and k < 308]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = queries.QUERIES["op11_disclosure"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.sql(SQL["op11_disclosure"])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    rows, terms = D.find_personal(docs)
    assert rows.collect() == [] and terms.collect() == [] and D.sanitise(docs, rows).collect() == []


def test_common_entity_hides_nothing(spark):
    docs = [(i, f"word{'abcdefgh'[i % 8]} contact info@site.org imprint line{'abcdefgh'[i // 8]}") for i in range(64)]
    rows, _ = D.find_personal(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {s["kind"] for r in rows.collect() for s in r["spans"]} == {"email"}


def test_long_texts_stay_linear(spark):
    texts = ["9" * 400_000, "a" * 400_000, "a@" * 200_000, "a@b" + ".c" * 200_000, "+1 " * 100_000, "1.1." * 50_000, "x.y@example.com " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, _ = D.find_personal(docs)
    sizes = {r["id"]: len(r["spans"]) for r in rows.select("id", "spans").collect()}
    assert sizes == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 25_000, 6: 20_000}
    out = {r["doc_id"]: r["n"] for r in D.sanitise(docs, rows).select("doc_id", F.length("text").alias("n")).collect()}
    assert out[6] == 20_000 * len("[EMAIL] ") and out[0] == 400_000

