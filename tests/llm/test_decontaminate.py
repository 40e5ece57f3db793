"""Spaced seeds: what the masks guarantee, and overlaps against brute force."""

import itertools
import random
import re

import pytest

from fleetlens.llm import decontaminate as D


def split(t):
    return re.split(r"[^\w]+|_+", (t or "").lower())


def brute(docs, items, window=20, least=13):
    out = set()
    for i, t in docs:
        w = split(t)
        for j, u in items:
            iw = [x for x in split(u) if x]
            if i is None or j is None or t is None or not iw:
                continue
            size = min(window, len(iw))
            percent = 100 if len(iw) < least else 80
            for shift in range(-len(iw), len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(iw)]
                if sum(same) * 100 >= size * percent and max(sum(same[s : s + size]) for s in range(len(iw) - size + 1)) * 100 >= size * percent:
                    out.add((i, j))
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, item string, h int, item_id int")
    t = spark.createDataFrame([(j, u, 5) for j, u in items], "item_id long, text string, doc_id int")
    return D.found_items(d, t, **options)


def test_every_window_within_the_limit_holds_a_seed():
    masks = [int(m, 2) for m in D.MASKS]
    for size in range(13, 21):
        seeds = [m << s for m in masks for s in range(size - m.bit_length() + 1)]
        for gone in itertools.combinations(range(size), size - -(-80 * size // 100)):
            bad = sum(1 << g for g in gone)
            assert any(not s & bad for s in seeds), (size, gone)


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_substitutions_equal_brute_force(spark, rows):
    """Both joins, broadcast and shuffled."""
    rnd = random.Random(8)
    items = [(j, " ".join(f"W{rnd.randint(0, 60)}" for _ in range(rnd.choice((1, 5, 12, 13, 15, 20, 33, 50))))) for j in range(25)]
    docs = []
    for i in range(120):
        w = [f"x{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 25))]
        iw = split(rnd.choice(items)[1])
        a = rnd.randint(0, 6)
        iw = [x if rnd.random() > rnd.choice((0, 0.15, 0.25)) else "zz" for x in iw][a if rnd.random() < 0.3 else 0 :]
        docs.append((i, ", ".join(w + iw + w[:3])))
    got = run(spark, docs, items, broadcast_rows=rows).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) and len(got) == len(brute(docs, items)) > 20


def test_position_and_counts(spark):
    item = " ".join(f"q{i}" for i in range(30))
    words = [f"q{i}" for i in range(30)]
    words[12] = words[25] = "other"
    (r,) = run(spark, [(1, "one two " + " ".join(words))], [(9, item)]).collect()
    assert (r.first_word, r.matched, r.compared, r.item_matched, r.item_words) == (2, 19, 20, 28, 30)


def test_edges(spark):
    p = " ".join(f"p{i}" for i in range(15))
    docs = [(1, None), (2, ""), (3, p), (3, p), (3, "nothing here"), (None, p), (4, "! " + p.upper().replace(" ", " -- ")), (5, ("w " * 50_000) + p), (6, " ".join(p.split()[:11]))]
    items = [(1, p), (2, None), (3, ""), (4, "too short"), (None, p), (1, p), (5, "w " * 20)]
    got = run(spark, docs, items)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(3, 1), (4, 1), (5, 1), (5, 5)]
    for a, b in (([], items), (docs, []), ([], [])):
        assert run(spark, a, b).count() == 0
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text) for r in D.clean(frame, got).collect() if r.text != None) == [(0, p), (2, ""), (6, docs[-1][1])]  # noqa: E711
