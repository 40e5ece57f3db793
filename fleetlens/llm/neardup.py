"""Near-duplicate components by HyperMinHash.

A document is the set of its distinct word shingles (64-bit hashes).  Its
sketch has 128 buckets; a shingle's leading bits choose the bucket, and the
bucket keeps the smallest remaining value, compressed to a leading-zero count
and ten mantissa bits (two bytes).

1. Documents with equal sets form one class; only its smallest id goes on.
2. Bands of four registers are hashed; classes that agree in a band are a group.
3. In groups of up to ``SMALL`` members every pair is a candidate.  A larger
   group has a leader, the member whose id hashes smallest, and only pairs with
   the leader are candidates; groups with one leader make one crowd.
4. Candidates pass if the collision-corrected Jaccard estimate of their
   registers is within five standard deviations of the threshold, and are then
   confirmed on the full sets.  Components of the links follow.
5. A crowd that lies in one component needs nothing more.  In any other, each
   member outside the crowd's largest component is compared with all members:
   both sides are dealt into blocks, a task gets one block of each, counts the
   common shingles of all its pairs through an inverted index and returns one
   link per member and component at most.
6. Components of all links by repeated minimum with shortcuts.

Rows moved follow the group's size for copies and near copies that their leader
joins; only members that stay apart from their crowd meet all of it, as blocks,
never as pairs.  No group is cut.  A link can be missed by the bands, at
J = 0.75 with probability (1 - 0.75**4)**32 = 5e-6, less above, or by step 4's
filter, if the estimate of a true pair lies five standard deviations low.

Defined results: text null or without words gives an empty set, its own
component, kept.  Fewer words than the shingle length: the whole sequence is
the one shingle.  Rows that repeat an id are one document holding several
sets.  A null id is linked with nothing: component null, kept.  An empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import words
from fleetlens.llm.common import BROADCAST_ROWS, join_checked, slices
from fleetlens.session import write_shared

BUCKETS, ROWS = 128, 4
MANTISSA = 10
SMALL = 8
SALTS = 8
BLOCK_SHINGLES = 400_000
#: Rows of an Arrow batch that holds texts or full sets: some MB, in the JVM and in Python.
BATCH_ROWS = 1000
_U = np.uint64


def shingles(texts: list[str | None], length: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text (A-Z lowered)."""
    w = words.split(texts, lower=True)
    hashes, first = words.runs(w, length)
    at = np.searchsorted(first, w.offsets)
    out = []
    for i, n in enumerate(np.diff(w.offsets).tolist()):
        if n >= length:
            out.append(np.unique(hashes[at[i] : at[i + 1]]))
        elif n == 0:
            out.append(np.zeros(0, np.uint64))
        else:  # the whole sequence, told apart from longer shingles by its length
            mine = w.hash[w.offsets[i] : w.offsets[i + 1]]
            value = np.zeros(1, np.uint64)
            for x in mine:
                value = words.mix(value + x)
            out.append(words.mix(value + _U(n)))
    return out


_STARTS = np.arange(BUCKETS, dtype=np.uint64) << _U(57)


def sketch(shingle_set: np.ndarray) -> np.ndarray:
    """Registers of a sorted set; 0 is an empty bucket."""
    begin = np.searchsorted(shingle_set, _STARTS)
    filled = begin < np.append(begin[1:], len(shingle_set))
    # the first hash of a bucket is its smallest; 53 bits below the bucket's are exact as a float
    value = ((shingle_set[begin[filled]] << _U(7)) >> _U(11)).astype(np.float64) + 1
    fraction, exponent = np.frexp(value)
    zeros = 55 - exponent  # 1 to 54, so that no filled register is 0
    out = np.zeros(BUCKETS, np.uint16)
    out[filled] = zeros * (1 << MANTISSA) + ((2 * fraction - 1) * (1 << MANTISSA)).astype(np.int64)
    return out


def band_keys(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band with a filled register; registers is 2-d."""
    n = len(registers)
    bands = registers.reshape(n, BUCKETS // ROWS, ROWS).astype(np.uint64)
    key = words.mix(np.arange(1, BUCKETS // ROWS + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))[None, :].repeat(n, axis=0)
    for j in range(ROWS):
        key = words.mix(key + bands[:, :, j])
    row, band = np.nonzero(bands.any(axis=2))
    return row, key[row, band]


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register pairs, less the matches that compression
    makes by chance, and the number of buckets they rest on."""
    used = np.maximum(((left > 0) | (right > 0)).sum(axis=1), 1)
    same = ((left == right) & (left > 0)).sum(axis=1)
    ratio = n_left / n_right
    chance = 0.169919 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2 * used
    return np.clip((same - chance) / used, 0, 1), used


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The sets of a column without nulls, as views of its buffer: no copies."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    return [np.frombuffer(data, np.uint64, (b - a) // 8, a) if b > a else np.zeros(0, np.uint64) for a, b in itertools.pairwise(at)]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (set size), h1 and h2 (digest of the set), regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            sets = shingles(piece.column(1).to_pylist())
            h1 = words.signed(np.array([words.mix(s ^ _U(0xA5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64))
            h2 = words.signed(np.array([words.mix(s + _U(0x1234567)).sum(dtype=np.uint64) for s in sets], np.uint64))
            sizes = np.array([len(s) for s in sets], np.int64)
            regs = [sketch(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(sizes), pa.array(h1), pa.array(h2), pa.array(regs, pa.binary())], names=["id", "n", "h1", "h2", "regs"]
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, n long, h1 long, h2 long, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                p = b.slice(a, 1000)
                row, key = band_keys(_matrix(p.column(2), np.uint16, BUCKETS))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(words.signed(key)), p.column(0).take(row), p.column(1).take(row)], names=["g", "id", "n"])

    return reps.select("id", "n", "regs").mapInArrow(run, "g long, id long, n long")


def _with_leaders(groups: DataFrame) -> DataFrame:
    """Members of groups of two and more, each with its group's leader (the id
    with the smallest hash) and size m.  The join is salted: a group may hold a
    third of all rows."""
    leaders = (
        groups.groupBy("g")
        .agg(F.min(F.struct(F.xxhash64("id").alias("order"), "id", "n")).alias("lead"), F.count("*").alias("m"), F.max("id").alias("top"), F.min("id").alias("low"))
        .where("m > 1 and top > low")
        .select("g", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(leaders, ["g", "salt"]).select("g", "id", "n", "lead", "lead_n", "m")


def _candidates(members: DataFrame, tenths: int) -> DataFrame:
    """Distinct pairs (a, b): all of small groups, those with the leader of
    large ones; sizes must allow the similarity."""
    near = F.col("na") * 100 >= F.col("nb") * tenths
    near &= F.col("nb") * 100 >= F.col("na") * tenths
    small = members.where(F.col("m") <= SMALL).select("g", "id", "n")
    pairs = small.select("g", F.col("id").alias("a"), F.col("n").alias("na")).join(small.select("g", F.col("id").alias("b"), F.col("n").alias("nb")), "g").where("a < b")
    stars = members.where(F.col("m") > SMALL).where("id <> lead").select(
        F.least("id", "lead").alias("a"),
        F.when(F.col("id") < F.col("lead"), F.col("n")).otherwise(F.col("lead_n")).alias("na"),
        F.greatest("id", "lead").alias("b"),
        F.when(F.col("id") < F.col("lead"), F.col("lead_n")).otherwise(F.col("n")).alias("nb"),
    )
    return pairs.drop("g").unionByName(stars).where(near).select("a", "b").distinct()


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimate is not clearly below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            left, right = (_matrix(b.column(i), np.uint16, BUCKETS) for i in (3, 5))
            sizes = [b.column(i).to_numpy().astype(np.float64) for i in (2, 4)]
            j, used = estimate(left, right, *sizes)
            good = j >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / used)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], names=["a", "b"])

    left = reps.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("regs").alias("r1"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("regs").alias("r2"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n1", "r1", "n2", "r2")
    return both.mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Full sets (sorted 8-byte hashes) of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            sets = shingles(piece.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "members"])

    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    some = join_checked(some, write_shared(ids, "set-ids"), ["id"], "left_semi")
    return some.mapInArrow(run, "id long, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            pa.default_memory_pool().release_unused()  # what the batch before has left
            good = []
            for x, y in zip(_lists(b.column(2)), _lists(b.column(3)), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_())), b.column(1).filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("s1"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("s2"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s1", "s2").mapInArrow(run, "a long, b long")


def _crowds(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members of crowds that lie in several components: lead, id, component,
    apart (not in the largest one) and the numbers of blocks of either side."""
    crowd = members.where(F.col("m") > SMALL).select("lead", "id", "n").distinct()
    crowd = write_shared(crowd.join(known, "id", "left").select("lead", "id", "n", F.coalesce("component", "id").alias("component")), "crowds")
    parts = crowd.groupBy("lead", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    whole = parts.groupBy("lead").agg(F.max(F.struct("k", "n", "component")).alias("big"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    rows = F.greatest(F.lit(128.0), F.least(F.lit(4096.0), 4 * F.sqrt("k")))  # of a block

    def blocks(k: Column, n: Column) -> Column:
        return F.greatest(F.ceil(k / rows), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")

    plan = whole.select(
        "lead",
        F.col("big.component").alias("big"),
        blocks(F.col("k"), F.col("n")).alias("all_blocks"),
        blocks(F.col("k") - F.col("big.k"), F.col("n") - F.col("big.n")).alias("apart_blocks"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salted = crowd.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(plan, ["lead", "salt"])
    return salted.select("lead", "id", "component", (F.col("component") != F.col("big")).alias("apart"), "all_blocks", "apart_blocks")


def _links_in_crowds(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside crowds (step 5)."""
    rows = crowds.join(sets, "id")

    def every(count: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(name)

    def deal(count: str, seed: int, name: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.col(count)).cast("int").alias(name)

    apart = rows.where("apart").select("lead", deal("apart_blocks", 1, "i"), every("all_blocks", "j"), "id", "component", "members")
    whole = rows.select("lead", every("apart_blocks", "i"), deal("all_blocks", 2, "j"), "id", "component", "members")
    whole = whole.toDF(*whole.columns)  # columns of its own beside those of ``apart``

    def block(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            theirs = [np.frombuffer(x, np.uint64) for x in right["members"]]
            sizes = np.array([len(x) for x in theirs])
            flat, owner = np.concatenate(theirs), np.repeat(np.arange(len(theirs)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            ids, component = right["id"].to_numpy(), right["component"].to_numpy()
            for me, mine, raw in zip(left["id"], left["component"], left["members"], strict=True):
                x = np.frombuffer(raw, np.uint64)
                low, high = np.searchsorted(flat, x), np.searchsorted(flat, x, side="right")
                length = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                common = np.bincount(owner[at], minlength=len(ids))
                good = np.flatnonzero((common > 0) & (100 * common >= percent * (len(x) + sizes - common)) & (component != mine))
                first = np.unique(component[good], return_index=True)[1]
                out += [(me, y) for y in ids[good[first]]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return apart.groupBy("lead", "i", "j").cogroup(whole.groupBy("lead", "i", "j")).applyInPandas(block, "a long, b long")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable.

    Every round takes the minimum over neighbours and then follows the
    component's own component, so long chains halve."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = write_shared(edges.distinct(), f"{label}-edges")
    state = write_shared(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("id"), "c"), label)
    while True:
        near = edges.join(state.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("nc")).select(F.col("a").alias("id"), "nc")
        step = state.join(near, "id").select("id", "c", F.least("c", "nc").alias("nc"))
        further = state.select(F.col("id").alias("nc"), F.col("c").alias("cc"))
        new = step.join(further, "nc", "left").select("id", F.least("nc", F.coalesce("cc", "nc")).alias("c"), (F.least("nc", F.coalesce("cc", "nc")) < F.col("c")).alias("moved"))
        new = write_shared(new, label)
        state = new.select("id", "c")
        if not new.where("moved").limit(1).count():
            return state.select("id", F.col("c").alias("component"))


def _same_id(sketched: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between an id that holds several sets and their classes."""
    rows = sketched.where("n > 0 and id is not null").select("id", "n", "h1", "h2").distinct()
    several = rows.groupBy("id").count().where("count > 1").select("id")
    classes = reps.select("n", "h1", "h2", F.col("id").alias("rep"))
    return rows.join(several, "id", "left_semi").join(classes, ["n", "h1", "h2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))


def _written_in_small_batches(df: DataFrame, label: str) -> DataFrame:
    """``write_shared`` with at most ``BATCH_ROWS`` rows in an Arrow batch (fewer, if the session says so)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        return write_shared(df, label)
    finally:
        conf.set(key, before)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Per row of ``docs``: id, n (set size), component (smallest id reachable)."""
    sketched = _written_in_small_batches(sketches(docs, id_col, text_col), "sketches")
    reps = write_shared(
        sketched.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("id"), F.first("regs").alias("regs")), "classes"
    )
    members = write_shared(_with_leaders(_bands(reps)), "groups")
    passed = write_shared(_estimated(_candidates(members, percent), reps, percent / 100), "pairs")
    crowded = members.where(F.col("m") > SMALL)
    wanted = passed.select(F.col("a").alias("id")).unionByName(passed.select(F.col("b").alias("id"))).unionByName(crowded.select("id")).distinct()
    sets = _written_in_small_batches(_sets(docs, wanted, id_col, text_col), "sets")
    links = _written_in_small_batches(_confirmed(passed, sets, percent).unionByName(_same_id(sketched, reps)), "links")
    known = components(links)
    more = write_shared(_links_in_crowds(_crowds(members, known), sets, percent), "crowd-links")
    if more.limit(1).count():
        known = components(links.unionByName(more))
    # the class's smallest id stands for all its members
    named = reps.select("n", "h1", "h2", F.col("id").alias("rep")).join(known.withColumnRenamed("id", "rep"), "rep", "left")
    named = write_shared(named.select("n", "h1", "h2", F.coalesce("component", "rep").alias("component")), "named")
    out = sketched.select("id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n", own.alias("component"))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is their component's; of rows that repeat
    an id the one whose columns sort first.  Null ids stay."""
    found = write_shared(found.select(F.col(id_col).alias("id"), "component"), "found")
    gone = write_shared(found.where("component < id").select("id").distinct(), "gone")
    key = F.col(id_col).cast("long")
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key == gone["id"], "left_anti")
    twice = write_shared(found.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "twice")
    n = twice.count()
    if not n:
        return left
    twice = F.broadcast(twice) if n <= BROADCAST_ROWS else twice
    same = left.join(twice, key == twice["id"], "left_semi")
    first = same.groupBy(key.alias("_key")).agg(F.min_by(F.struct("*"), F.to_json(F.struct("*"))).alias("_row")).select("_row.*")
    return left.join(twice, key == twice["id"], "left_anti").unionByName(first)
