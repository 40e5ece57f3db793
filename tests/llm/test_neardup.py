"""Near-duplicate components against brute force on full sets."""

import random

import numpy as np
import pyarrow as pa

from fleetlens.llm import neardup as N

SCHEMA = "doc_id long, text string, n int, component int, regs string"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is None or j is None or not s or not t:
                continue
            c = len(s & t)
            if 100 * c >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 0, 0, "") for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=repr)


def text(rnd, n):
    return [f"w{rnd.randint(0, 3000)}" for _ in range(n)]


def test_large_groups_of_near_copies(spark):
    """Groups far over SMALL, many members linked to some others only."""
    rnd = random.Random(2)
    rows = []
    for base_len, copies, edits in ((120, 90, 5), (60, 60, 3), (200, 40, 9)):
        base = text(rnd, base_len)
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
            rows.append(w)
        child = list(rows[-1])  # copies of a copy
        for _ in range(12):
            w = list(child)
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
            rows.append(w)
    line = text(rnd, 9)
    rows += [line + text(rnd, rnd.randint(0, 12)) for _ in range(80)]  # short texts with a common line
    rows += [text(rnd, rnd.randint(0, 8)) for _ in range(40)]
    rnd.shuffle(rows)
    rows = [(i + 1, " ".join(w)) for i, w in enumerate(rows)]
    got, want = run(spark, rows), brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 60


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(25_000))
    rows = [(5, "One two THREE"), (6, "one Two three"), (7, "one two three four"), (1, None), (2, ""), (3, " \n "), (8, long), (9, long + " x"), (None, "one two three")]
    rows += [(10, "a b c d e f g"), (10, "a b c d e f g"), (11, "Éa b c d e"), (12, "éa b c d e")]
    assert run(spark, rows) == brute(rows)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(4, "a b c d e f g h"), (4, "p q r s t u v w"), (2, "p q r s t u v w"), (3, "a b c d e f g h")]
    assert brute(rows) == run(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = N.one_of_each(df, N.near_duplicates(df)).collect()
    assert [tuple(r) for r in kept] == [(2, "p q r s t u v w")]


def test_one_of_each_keeps_clean_rows_and_columns(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "A B c d e f", 2), (3, "other words here now then", 3), (None, "a b c d e f", 4), (4, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int")
    kept = N.one_of_each(df, N.near_duplicates(df))
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([rows[0], rows[3], rows[4], rows[5]], key=repr)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_estimate_follows_jaccard():
    rng = np.random.default_rng(1)
    for j in (0.0, 0.3, 0.75, 1.0):
        union = rng.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2)
        shared = int(6000 * j)
        left, right = union[: shared + (6000 - shared) // 2], np.concatenate([union[:shared], union[shared + (6000 - shared) // 2 :]])
        a, b = (N.sketch(np.unique(x))[None, :] for x in (left, right))
        got, used = N.estimate(a, b, np.array([len(left)]), np.array([len(right)]))
        assert used[0] == 128 and abs(got[0] - j) < 0.15
    empty = np.zeros((1, 128), np.uint16)
    assert N.estimate(empty, empty, np.array([1.0]), np.array([1.0]))[0][0] == 0
    assert (N.sketch(np.zeros(0, np.uint64)) == 0).all()


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103)]
    got = dict(map(tuple, N.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 103: 100, 105: 100}


def test_texts_and_sets_go_in_small_batches(spark, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, N.write_shared

    def noted(df, label, *args):
        seen[label] = int(spark.conf.get(key))
        return write(df, label, *args)

    monkeypatch.setattr(N, "write_shared", noted)
    before = spark.conf.get(key)
    rows = [(i, f"a b c d e f g h {'x' * (i % 3 == 0)}") for i in range(20)]
    assert run(spark, rows) == brute(rows)
    assert all(seen[x] <= 1000 for x in ("sketches", "sets", "links")) and spark.conf.get(key) == before


def test_sets_are_views_of_their_column():
    sets = [np.arange(n, dtype=np.uint64) * np.uint64(2**60 + 7) for n in (3, 0, 1, 5, 0)]
    column = pa.array([x.tobytes() for x in sets], pa.binary())
    for part, want in ((column, sets), (column.slice(1, 3), sets[1:4]), (column.slice(1, 1), sets[1:2]), (column.slice(2, 0), [])):
        got = N._lists(part)
        assert len(got) == len(want) and all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))
    data = np.frombuffer(column.buffers()[2], np.uint8)
    assert all(np.shares_memory(x, data) for x in N._lists(column) if len(x))
