"""Runs by the automaton against every period tried in turn."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import periodic_runs as R
from fleetlens.llm import queries


def brute(words, least=12):
    """Maximal stretches per period; those inside one of a smaller period go."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - (i - q)
            if length >= max(least, 2 * q) and not any(s <= start and s + m >= start + length for s, m, _ in found):
                found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(rnd, n):
    out = []
    for _ in range(n):
        size, letters = rnd.randint(0, 150), rnd.choice([1, 2, 2, 3, 6])
        words = []
        while len(words) < size:
            if words and rnd.random() < 0.5:
                i = rnd.randrange(len(words))
                words += words[i : rnd.randint(i, len(words))] * rnd.choice([1, 2, 3])
            else:
                words.append(b"%d" % rnd.randrange(letters))
        out.append(words[:300])
    return out


@settings(max_examples=200, deadline=None, derandomize=True)
@given(words=st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), least=st.integers(2, 14))
def test_small_alphabets(words, least):
    assert R.runs_of([words], least) == [brute(words, least)]


def test_repetitive_texts():
    many = texts(random.Random(1), 150)
    assert R.runs_of(many) == [brute(w) for w in many]


def test_fibonacci_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    found = R.runs_of([b])[0]
    assert found == brute(b) and len(found) > 100


def test_the_automaton_decides(monkeypatch):
    """Nothing but the finder makes runs."""
    words = [b"x", b"y", b"z"] * 30
    assert R.runs_of([words]) == [[(0, 90, 3)]]
    monkeypatch.setattr(R.RunFinder, "append", lambda self, word: None)
    assert R.runs_of([words]) == [[]]


def test_stretches_cover_every_run_and_drop_plain_text():
    rnd = random.Random(2)
    plain = [b"w%d" % rnd.randrange(10**6) for _ in range(500)]
    line = [b"l%d" % i for i in range(40)]
    words = plain[:100] + line + plain[100:300] + line + plain[300:] + line * 3 + plain[:50]
    number = np.array([hash(w) for w in words])
    cut = R.stretches(number, np.zeros(len(words), int), 12)
    start = 580
    assert cut == [(start, start + 120)]
    assert R.runs_of([words])[0] == [(start, 120, 40)]


def test_long_text_is_linear_in_states():
    finder = R.RunFinder()
    for i in range(30_000):
        finder.append(i % 700)
    assert finder.runs(12) == [(0, 30_000, 700)] and len(finder.length) <= 2 * 30_000


def fold(i, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
    return words


def rows():
    rnd = random.Random(3)
    out = [(i, None if i % 17 == 0 else " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 90)))) for i in range(120)]
    out += [(200, ""), (201, " \t\n "), (202, "é é " * 20), (203, "w " * 5000), (204, "w  " * 30), (None, "a b " * 9), (205, "a b " * 9), (205, "a b " * 9)]
    return out


@pytest.fixture()
def docs(spark):
    schema = "doc_id long, text string, runs int, id string, kept string, n_words int"
    return spark.createDataFrame([(i, t, 0, "", "", 0) for i, t in rows()], schema)


def test_operator(docs):
    got = sorted(((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept"]) for r in R.find_runs(docs).collect()), key=repr)
    want = []
    for i, t in rows():
        words = (t or "").encode().split()
        runs = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((i, len(words), runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert got == sorted(want, key=repr)


def test_refolded(docs):
    got = sorted(((r["doc_id"], (r["text"] or "").encode().split()) for r in R.refolded(docs).collect()), key=repr)
    assert got == sorted(((i, (t or "").encode().split() if i is None else fold(i, t)) for i, t in rows()), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert R.find_runs(R.refolded(docs)).collect() == []
    assert "op13_periodic_runs" in queries.QUERIES
