"""Repeated windows against brute force."""

import random
import re

from pyspark.sql import functions as F

from fleetlens.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, kept string, v int, ranges int"


def brute(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    low = {}
    for i, w in split:
        if i is not None:
            for a in range(len(w) - window + 1):
                k = tuple(w[a : a + window])
                low[k] = min(low.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for a in range(len(w) - window + 1):
                if low[tuple(w[a : a + window])] < i:
                    gone.update(range(a, a + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA)
    got = S.remove_repeats(df, **options)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_random_texts_equal_brute_force(spark):
    rnd = random.Random(4)
    passages = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(5, 25))] for _ in range(6)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += [rnd.choice("xyz") + str(rnd.randint(0, 400)) for _ in range(rnd.randint(0, 12))]
            p = rnd.choice(passages)
            a = rnd.randint(0, 4)
            words += p[a : a + rnd.randint(2, 25)]
        rows.append((i * 7 % 151, rnd.choice([" ", "\n", "\t "]).join(words)))
    rows += [(3, "w " * 40), (9, "w " * 30)]  # one word over and over; ids that repeat
    assert run(spark, rows, window=8, phrase=3) == brute(rows, 8)
    assert run(spark, rows, window=5, phrase=5) == brute(rows, 5)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    a = " ".join(f"a{i}" for i in range(60))
    rows = [
        (1, a),
        (1, a),  # a repeated row is not smaller than itself
        (2, "x " + a + " y"),
        (3, a.replace(" ", "\n\n")),  # equal words, other white space
        (4, None),
        (5, ""),
        (6, "  \n "),
        (7, long),
        (8, "é🎉 " + long),
        (9, " ".join(a.split()[:49])),  # shorter than a window
        (None, a),
    ]
    assert run(spark, rows) == brute(rows, 50)


def test_many_copies_and_a_common_passage(spark):
    p = " ".join(f"p{i}" for i in range(55))
    rows = [(i, p if i % 3 else f"h{i} {p} t{i}") for i in range(400)]
    assert run(spark, rows) == brute(rows, 50)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_ranges_are_word_numbers(spark):
    a = " ".join(f"a{i}" for i in range(50))
    df = spark.createDataFrame([(1, a), (2, "b c " + a + " d")], "doc_id long, text string")
    (row,) = S.repeated_ranges(df).select("id", F.col("ranges")).collect()
    assert row.id == 2 and [tuple(r) for r in row.ranges] == [(2, 52)]


def shared_passages(n=120):
    rnd = random.Random(5)
    passages = [" ".join(f"p{k}x{j}" for j in range(70)) for k in range(15)]
    return [(i, " ".join([f"a{i} b{i}", *rnd.sample(passages, rnd.randint(0, 3)), f"c{i}"])) for i in range(n)]


def test_shards_and_parts_of_any_size_give_the_same(spark, monkeypatch):
    rows = shared_passages()
    want = brute(rows, 50)
    for phrases, words in ((1, 100), (7, 2000), (10_000, 10)):
        monkeypatch.setattr(S, "SHARD_PHRASES", phrases)
        monkeypatch.setattr(S, "PART_WORDS", words)
        assert run(spark, rows) == want


def test_the_automata_decide(spark, monkeypatch):
    """Without what they return nothing is removed; with some of it, less."""
    import sys

    from pyspark import cloudpickle

    rows = shared_passages(40)
    assert sum(r[2] for r in brute(rows, 50)) > 1000
    # tasks get the changed function by value
    cloudpickle.register_pickle_by_value(sys.modules[S.__name__])
    try:
        monkeypatch.setattr(S, "occurrences", lambda made, number: [])
        assert sum(r[2] for r in run(spark, rows)) == 0
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[S.__name__])


def test_automaton_finds_every_phrase():
    made = S.automaton([(1, 2, 3), (2, 3, 4), (3, 3, 3)])
    assert S.occurrences(made, (0, 1, 2, 3, 4, 3, 3, 3, 3, 2**31 - 1)) == [3, 4, 7, 8]
    assert S.automaton([]) is None
