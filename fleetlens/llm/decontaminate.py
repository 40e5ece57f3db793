"""Benchmark decontamination with spaced-seed hashes, in DataFrame functions only.

Texts are words (letters and digits, lower case).  A spaced seed is a mask
such as ``110101011``: laid over consecutive words it hashes those at the ones
and ignores the others, so two passages that differ at an ignored word still
agree.  Hashes of all masks at all positions of documents are joined with
those of the benchmark items; a hit fixes how the item would lie over the
document.  Around it the two are compared word by word: an item is found if
some window of ``window`` item words (the whole item, if shorter) agrees with
the document in at least ``percent`` of its words.

The four masks were chosen so that every window of 13 to 20 words that reaches
80 % holds a complete seed, wherever its differing words are (checked by
enumeration in the tests), so nothing within the limit is missed.

The benchmark's hashes are broadcast only while their counted number is within
``broadcast_rows``; beyond that the join is a shuffled one with salted keys.
Document texts are never shuffled for the search: hits carry ids, and texts
are read again for the documents that have hits.

Items of fewer than ``min_words`` words are too short for the masks: they are
found only whole, as one solid seed of all their words, without substitutions.

Defined results: null or empty texts and items are never found.
Rows that repeat an id are one document; an item found in any of them is
found.  A null id has no result row.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import BROADCAST_ROWS, join_checked
from fleetlens.session import write_shared

MASKS = ("110101011", "11000100111", "1111011", "1101001101")
SALTS = 8


def words(text: str) -> Column:
    """Lower-case words of letters and digits; a text may begin and end with an
    empty word, which equals no item's word."""
    return F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")


def seeds(df: DataFrame, keys: list[str], words_col: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """Rows (keys, pos, h): the hash of every mask at every position."""
    least = min(map(len, masks))
    hashed = df.select(*keys, F.transform(words_col, lambda w: F.xxhash64(w)).alias("_h")).where(F.size("_h") >= least)
    at = hashed.select(*keys, "_h", F.explode(F.sequence(F.lit(0), F.size("_h") - least)).alias("pos"))
    # a mask that reaches past the end reads a null, which hashes to nothing an item has
    one = [
        F.when(F.col("pos") + len(m) <= F.size("_h"), F.xxhash64(F.lit(m), *[F.get("_h", F.col("pos") + j) for j, bit in enumerate(m) if bit == "1"]))
        for m in masks
    ]
    return at.select(*keys, "pos", F.explode(F.array(*one)).alias("h")).where("h is not null")


def found_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 20,
    percent: int = 80,
    min_words: int = 13,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Pairs (id, item) that overlap: ``first_word`` (number of the document
    word where the best window starts), ``matched`` and ``compared`` words of
    that window, ``item_matched`` and ``item_words`` of the item as a whole."""
    tests = (
        items.select(F.col(item_col).alias("item"), F.filter(words(item_text_col), lambda w: w != "").alias("iw"))
        .where(F.col("item").isNotNull() & (F.size("iw") > 0))
        .distinct()
        .withColumn("size", F.size("iw"))
    )
    tests = write_shared(tests, "items")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    # an item too short for the masks is one solid seed: all its words
    short = tuple("1" * r["size"] for r in tests.where(F.col("size") < min_words).select("size").distinct().orderBy("size").collect())
    item_seeds = seeds(tests.where(F.col("size") >= min_words), ["item", "size"], "iw")
    for m in short:  # fewer than min_words
        item_seeds = item_seeds.unionByName(seeds(tests.where(F.col("size") == len(m)), ["item", "size"], "iw", (m,)))
    wanted = write_shared(item_seeds.select("h", "item", "size", F.col("pos").alias("ipos")).distinct(), "item-seeds")
    stream = seeds(base.withColumn("w", words("text")), ["id", "v"], "w", MASKS + short)
    if wanted.count() <= broadcast_rows:
        met = stream.join(F.broadcast(wanted), "h")
    else:
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = stream.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    hits = write_shared(met.select("id", "v", "item", "size", (F.col("pos") - F.col("ipos")).alias("shift")).distinct(), "hits")
    # one text's hits meet its text once; each takes only the words the item would cover
    holders = hits.groupBy("id", "v").agg(F.collect_list(F.struct("item", "shift", "size")).alias("hits"))
    holders = F.broadcast(holders) if hits.count() <= BROADCAST_ROWS else holders
    texts = base.join(holders, ["id", "v"]).select("id", words("text").alias("w"), "hits")
    each = texts.select("id", "w", F.explode("hits").alias("hit")).select("id", "hit.item", "hit.shift", "hit.size", "w")
    begin = F.greatest(F.col("shift"), F.lit(0))
    stop = F.least(F.col("shift") + F.col("size"), F.size("w"))
    cover = F.slice("w", begin + 1, F.greatest(stop - begin, F.lit(0))).alias("part")
    laid = each.select("id", "item", "shift", cover).join(tests.select("item", "iw"), "item")
    same = F.transform("iw", lambda x, i: F.when(F.get("part", i + F.least(F.col("shift"), F.lit(0))) == x, 1).otherwise(0))
    laid = laid.select("id", "item", "shift", same.alias("same"), F.least(F.lit(window), F.size("iw")).alias("compared"))
    sums = F.transform(
        F.sequence(F.lit(1), F.size("same") - F.col("compared") + 1), lambda s: F.aggregate(F.slice("same", s, F.col("compared")), F.lit(0), lambda a, x: a + x)
    )
    scored = laid.select("id", "item", "shift", "compared", sums.alias("sums"), F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("item_matched"), F.size("same").alias("item_words"))
    needed = F.when(F.col("item_words") < min_words, 100).otherwise(percent)
    scored = scored.withColumn("matched", F.array_max("sums")).where(F.col("matched") * 100 >= F.col("compared") * needed)
    best = scored.groupBy("id", "item").agg(
        F.max(F.struct("matched", "item_matched", (-F.col("shift")).alias("back"), (-F.array_position("sums", F.col("matched"))).alias("at"), "compared", "item_words")).alias("b")
    )
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        (-F.col("b.back") - F.col("b.at") - 1).cast("long").alias("first_word"),
        F.col("b.matched").cast("long").alias("matched"),
        F.col("b.compared").cast("long").alias("compared"),
        F.col("b.item_matched").cast("long").alias("item_matched"),
        F.col("b.item_words").cast("long").alias("item_words"),
    )


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id has no row in ``found`` (null ids stay)."""
    return join_checked(docs, write_shared(found.select(id_col).distinct(), "contaminated"), [id_col], "left_anti")
