"""Substring deduplication with repeated-phrase automata.

A window of ``window`` consecutive words is repeated if the same words also
start in a document with a smaller id; every word that such a window covers is
removed.  Windows are judged on the input.

1. Texts with equal word sequences form one class; the copies behind its
   smallest id are repeated as a whole and need no search.
2. From every run of ``window - phrase + 1`` phrases (16 words each) the one
   with the smallest hash is sampled.  Two equal windows sample the same
   phrase, so every repeated window holds a sampled phrase that occurs in two
   documents.  Those phrases are confirmed over the corpus, grouped by two
   independent hashes (partial sums first); their words are then read from the
   document with the smallest id.
3. Confirmed phrases are dealt into shards of bounded size by that document,
   so that what was copied from one place lies in one shard.  Every document is
   routed to the shards that hold one of its sampled phrases (no other shard
   can hold a repeated window of it), in parts of bounded size.  A part
   compiles its shard's Aho-Corasick automaton (pyahocorasick, over 31-bit
   numbers of words that are the same in every task) once and streams its
   documents through it; windows around an occurrence are candidates.
4. Candidates are confirmed over the corpus: grouped by two independent
   hashes of their words, a window is repeated in every document but the one
   with the smallest id.

Data moved: sampled phrases (one word in about 18), candidate windows, and the
texts of documents that hold a confirmed phrase, once per shard they meet.
Nothing is collected to the driver but one number of shards.

Defined results: null or empty text has no words and keeps the empty text.
Texts shorter than a window keep all words.  Rows that repeat an id do not
count as smaller to each other.  A null id takes no part: its words stay.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import words
from fleetlens.llm.common import join_checked, slices
from fleetlens.session import write_shared

WINDOW, PHRASE = 50, 16
SHARD_PHRASES = 10_000  #: phrases of one automaton, about
PART_WORDS = 500_000  #: words of the documents that one part streams, about
_U = np.uint64


def sampled(hashes: np.ndarray, run: int) -> np.ndarray:
    """Distinct hashes that are the smallest of some ``run`` consecutive ones."""
    if len(hashes) < run:
        return hashes[:0]
    low = hashes.copy()
    reach = 1  # low[i] is the minimum of hashes[i : i + reach]
    while reach < run:
        step = min(reach, run - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    return np.unique(low)


def _digests(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Per text of at least a window: n words, two digests, sampled phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 2):
            w = words.split(piece.column(2).to_pylist())
            count = np.diff(w.offsets)
            long_enough = np.flatnonzero(count >= window)
            hashes, first = words.runs(w, phrase)
            checks, _ = words.runs(w, phrase, 2)
            at = np.searchsorted(first, w.offsets)
            place = np.arange(len(w.hash)) - np.repeat(w.offsets[:-1], count)
            totals = []
            for seed in (0x9E3779B9, 0x7F4A7C15):
                each = words.mix(w.hash ^ words.mix(place.astype(np.uint64) * _U(0xA0761D6478BD642F) + _U(seed)))
                total = np.zeros(len(each) + 1, np.uint64)
                np.cumsum(each, dtype=np.uint64, out=total[1:])
                totals.append(words.signed(total[w.offsets[1:]] - total[w.offsets[:-1]])[long_enough])
            take = pa.array(long_enough)
            phrases, seconds = [], []
            for i in long_enough:
                mine = hashes[at[i] : at[i + 1]]
                chosen = sampled(mine, window - phrase + 1)
                order = np.argsort(mine, kind="stable")
                phrases.append(words.signed(chosen))
                seconds.append(_check(checks[at[i] : at[i + 1]][order[np.searchsorted(mine[order], chosen)]]))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(take), piece.column(1).take(take), pa.array(count[long_enough]), pa.array(totals[0]), pa.array(totals[1])]
                + [pa.array(phrases, pa.list_(pa.int64())), pa.array(seconds, pa.list_(pa.int32()))],
                names=["id", "v", "n", "s1", "s2", "phrases", "checks"],
            )

    return docs.mapInArrow(run, "id long, v long, n long, s1 long, s2 long, phrases array<long>, checks array<int>")


def _check(hashes: np.ndarray) -> np.ndarray:
    """Half of a second hash."""
    return (hashes >> _U(32)).astype(np.uint32).view(np.int32)


def numbers(w: words.Words) -> np.ndarray:
    """31-bit numbers of the words, the same for a word in every task."""
    return (w.hash >> _U(33)).astype(np.int64)


def _spelled(docs: DataFrame, phrase: int) -> DataFrame:
    """The words of phrases; docs: text, shard and ``phrases`` (hashes) to read from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 0):
            w = words.split(piece.column(0).to_pylist())
            hashes, first = words.runs(w, phrase)
            at = np.searchsorted(first, w.offsets)
            number = numbers(w)
            shards, spelled = [], []
            for i, (shard, wanted) in enumerate(zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True)):
                mine = hashes[at[i] : at[i + 1]]
                _, place = np.unique(mine, return_index=True)  # a phrase that repeats in the text: once
                for k in place[np.isin(mine[place], np.array(wanted, np.int64).view(np.uint64))]:
                    p = first[at[i] + k]
                    shards.append(shard)
                    spelled.append(number[p : p + phrase])
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(spelled, pa.list_(pa.int64()))], names=["shard", "spelled"])

    return docs.select("text", "shard", "phrases").mapInArrow(run, "shard int, spelled array<long>")


def automaton(spelled: list[tuple[int, ...]]):
    """Aho-Corasick automaton over sequences of word numbers; None if there are none."""
    import ahocorasick

    if not spelled:
        return None
    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for s in spelled:
        made.add_word(s)
    made.make_automaton()
    return made


def occurrences(made, number: tuple[int, ...]) -> list[int]:
    """Where the automaton's phrases end in a text."""
    return [end for end, _ in made.iter(number)]


WINDOWS = "h1 long, h2 int, id long, v long, pos int"


def _candidates(docs: DataFrame, phrases: DataFrame, window: int, phrase: int) -> DataFrame:
    """Windows around occurrences of confirmed phrases.  docs: shard, part, id,
    v, text; phrases: shard, part, spelled.  A part of a shard is one group."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("id", pa.int64()), ("v", pa.int64()), ("pos", pa.int32())])

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        made = automaton([tuple(x) for x in right.column("spelled").to_pylist()])
        out = []
        for piece in slices(iter(left.select(["id", "v", "text"]).to_batches()), 2) if made else ():
            w = words.split(piece.column(2).to_pylist())
            number = numbers(w).tolist()
            mark = np.zeros(len(w.hash) + 1, np.int64)
            for i in range(len(w.offsets) - 1):
                a, b = w.offsets[i], w.offsets[i + 1]
                found = np.array(occurrences(made, tuple(number[a:b])), np.int64) + a - phrase + 1
                np.add.at(mark, np.maximum(found - (window - phrase), a), 1)
                np.add.at(mark, found + 1, -1)
            h1, starts = words.runs(w, window, 1)
            h2, _ = words.runs(w, window, 2)
            chosen = np.flatnonzero(np.cumsum(mark)[starts] > 0)
            doc = w.doc()[starts[chosen]]
            pos = (starts[chosen] - w.offsets[doc]).astype(np.int32)
            take = pa.array(doc)
            out.append(pa.RecordBatch.from_arrays([pa.array(words.signed(h1[chosen])), pa.array(_check(h2[chosen])), piece.column(0).take(take), piece.column(1).take(take), pa.array(pos)], schema=schema))
        return pa.Table.from_batches(out, schema)

    keys = ["shard", "part"]
    return docs.groupBy(*keys).cogroup(phrases.groupBy(*keys)).applyInArrow(locate, WINDOWS)


def _matched(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with one row per key of ``groups``.  A key may stand in a
    third of ``rows``: both sides come from written tables and are shuffled for
    this join alone, so adaptive execution can split such a partition."""
    return rows.join(write_shared(groups, "keys"), keys)


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Per text with a repeated window: id, v (hash of the text) and ``ranges``,
    an array of (first, last) word numbers covered, ``last`` exclusive."""
    if not 1 <= phrase <= window:
        raise ValueError("a phrase must fit into a window")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("text")).where("id is not null")
    digests = write_shared(_digests(base, window, phrase), "digests")
    classes = write_shared(
        digests.groupBy("n", "s1", "s2").agg(
            F.min(F.struct("id", "v")).alias("rep"), F.min_by(F.struct("phrases", "checks"), F.struct("id", "v")).alias("p"), F.max("id").alias("top")
        ),
        "classes",
    )
    sampled_ = F.arrays_zip(F.col("p.phrases").alias("h"), F.col("p.checks").alias("c"))
    each = classes.select("rep.id", "rep.v", "n", F.explode(sampled_).alias("s")).select("id", "v", "n", "s.h", "s.c")
    confirmed = each.groupBy("h", "c").agg(F.min(F.struct("id", "v")).alias("low"), F.max("id").alias("high")).where("low.id < high").select("h", "c", "low")
    confirmed = write_shared(confirmed, "phrases")
    shards = max(1, -(-confirmed.count() // SHARD_PHRASES))
    confirmed = confirmed.withColumn("shard", F.pmod(F.xxhash64("low.id"), F.lit(shards)).cast("int"))
    # every text with the shards of its phrases, in parts of so many words
    routes = write_shared(_matched(each, confirmed.select("h", "c", "shard"), ["h", "c"]).select("id", "v", "n", "shard").distinct(), "routes")
    parts = routes.groupBy("shard").agg(F.ceil(F.sum("n") / PART_WORDS).cast("int").alias("parts"))
    parts = write_shared(parts, "parts")  # a row per shard
    dealt = join_checked(routes, parts, ["shard"], "inner")
    dealt = write_shared(dealt.select("id", "v", "shard", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part")), "dealt")
    docs_of = join_checked(base, dealt, ["id", "v"], "inner")
    lowest = write_shared(confirmed.groupBy("low", "shard").agg(F.collect_list("h").alias("phrases")).select("low.id", "low.v", "shard", "phrases"), "lowest")
    spelled = _spelled(join_checked(base, lowest, ["id", "v"], "inner", array="phrases"), phrase).distinct()
    spread = join_checked(spelled, parts, ["shard"], "inner").select("shard", "spelled", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    windows = write_shared(_candidates(docs_of, spread, window, phrase), "windows")
    repeated = windows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h1", "h2", "low")
    hits = _matched(windows, repeated, ["h1", "h2"]).where("id > low").groupBy("id", "v").agg(F.sort_array(F.collect_set("pos")).alias("starts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for starts in b.column(2).to_pylist():
                s = np.array(starts)
                cut = np.flatnonzero(np.diff(s) > window)  # ranges that touch are one
                out.append([{"first": int(f), "last": int(t) + window} for f, t in zip(s[np.append(0, cut + 1)], s[np.append(cut, len(s) - 1)], strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names=["id", "v", "ranges"])

    ranges = "ranges array<struct<first:int,last:int>>"
    partly = hits.select("id", "v", "starts").mapInArrow(merge, f"id long, v long, {ranges}")
    # copies of a class: repeated from the first to the last word
    several = classes.where("top > rep.id").select("n", "s1", "s2", F.col("rep.id").alias("low"))
    wholly = (
        digests.select("id", "v", "n", "s1", "s2")
        .join(several, ["n", "s1", "s2"])
        .where("id > low")
        .select("id", "v", F.array(F.struct(F.lit(0).alias("first"), F.col("n").cast("int").alias("last"))).alias("ranges"))
        .distinct()
    )
    both = partly.join(wholly.select("id", "v"), ["id", "v"], "left_anti").unionByName(wholly)
    return write_shared(both, "ranges")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed and ``kept``, the words that
    stay, joined by one blank."""
    ranges = repeated_ranges(docs, id_col, text_col, window, phrase)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("text"))
    joined = join_checked(base, ranges, ["id", "v"], "left", array="ranges").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            total, removed, kept = [], [], []
            for text, cuts in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                mine = (text or "").encode("utf-8", "surrogatepass").split()
                total.append(len(mine))
                for cut in reversed(cuts or []):
                    del mine[cut["first"] : cut["last"]]
                removed.append(total[-1] - len(mine))
                kept.append(b" ".join(mine))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"]
            )

    return joined.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept string")
