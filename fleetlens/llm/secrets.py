"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Three base kinds are found by fixed patterns, leftmost and without overlap per
kind, and always reported.  A fourth, generic kind is any long token of mixed
letters and digits; most such tokens are harmless, so the corpus decides: the
hash of every candidate value is counted over distinct owners (sources) and
distinct repositories (documents).  A value that more than ``max_owners``
owners have, or that stands in more than ``max_repos`` repositories, whoever
owns them, is a widely copied example; any other is live-looking.  Generic
tokens are reported only if live-looking; base spans carry the status.

Positions are code points, end exclusive, from the lengths of the pieces
between matches.  Counting is by (value, owner, repository), then (value,
owner), then value, with partial sums before every shuffle, and the way back
to the spans is salted: one example may stand in a third of all rows.  Texts
are read once; only spans (positions and value hashes) are written.

Defined results: a null or empty text has no span.  A null owner does not
count as an owner.  Rows that repeat an id and text have the same spans each;
rows that repeat an id with another text are told apart by the text's hash.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.arrays import let, running
from fleetlens.llm.common import join_checked
from fleetlens.llm.spans import matches, replaced
from fleetlens.session import write_shared

#: The base patterns (group of the value, least length of it).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: The generic kind: whole runs of token characters.
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"

KINDS = ("assign", "access", "hex", "owned")
SPAN = "array<struct<start:int,ord:int,kind:string,stop:int,hash:string>>"
SALTS = 16


def found(text: Column, pattern: str, ord_: int, group: int, least: int, maybe: Column) -> Column:
    """Spans of a pattern whose value (``group``) has ``least`` characters;
    ``maybe`` is a cheaper test that every text with a match passes."""

    def span(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), F.lit(ord_).alias("ord"), F.lit(KINDS[ord_]).alias("kind"), m["stop"].alias("stop"), F.sha2(m["value"].cast("binary"), 256).alias("hash"))

    good = F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least)
    return F.when(maybe, F.transform(good, span)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def apart(more: Column, base: Column) -> Column:
    """Spans of ``more`` that overlap none of ``base``: in the order of their
    starts, no base span before one reaches into it, and none behind it starts
    inside it."""

    def kept(every: Column) -> Column:
        low = -(2**31) + 1
        stops = F.transform(every, lambda s: F.when(s["ord"] < 3, s["stop"]).otherwise(low))
        starts = F.transform(every, lambda s: F.when(s["ord"] < 3, -s["start"]).otherwise(low))

        def most(values: Column) -> Column:
            return running(values, F.lit(low), lambda a, b: F.greatest(a, b))

        def choose(p: Column) -> Column:
            free = F.filter(
                F.transform(p["every"], lambda s, i: F.struct(s.alias("s"), ((F.get(p["before"], i) <= s["start"]) & (-F.get(p["behind"], i) >= s["stop"])).alias("free"))),
                lambda x: x["free"] & (x["s"]["ord"] == 3),
            )
            return F.transform(free, lambda x: x["s"])

        return let(F.struct(every.alias("every"), most(stops).alias("before"), F.reverse(most(F.reverse(starts))).alias("behind")), choose)

    return F.when(F.size(more) > 0, let(F.sort_array(F.concat(base, more)), kept)).otherwise(more)


def _mixed(text: Column) -> Column:
    """Generic tokens with a digit, a small and a capital letter."""
    look = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[a-z])(?=[A-Za-z0-9_-]*[A-Z])[A-Za-z0-9_-]{20,}+"
    return found(text, look, 3, 0, 20, text.rlike(TOKEN))


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """Per row: id, v (hash of the text), owner, base and generic spans."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"), F.col(owner_col).cast("string").alias("owner"), F.coalesce(text_col, F.lit("")).alias("_text"))
    base = F.concat(
        found(text, ASSIGN, 0, 2, 6, text.rlike(ASSIGN)),
        found(text, ACCESS, 1, 0, 20, text.contains("AKIA")),
        found(text, HEX, 2, 0, 24, text.rlike(HEX)),
    )
    rows = rows.select("id", "v", "owner", base.alias("base"), _mixed(text).alias("more"))
    return rows.select("id", "v", "owner", "base", apart(F.col("more"), F.col("base")).alias("more"))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) from rows (hash, owner, id, v)."""
    repos = spans.groupBy("hash", "owner", "id").agg(F.count("*").alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("n_repos"))
    return owners.groupBy("hash").agg(F.count("owner").alias("n_owners"), F.sum("n_repos").alias("n_repos"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_owners: int = 2, max_repos: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, found).  ``rows`` has id and v of every row of ``docs``;
    ``found`` has id, v and ``spans`` of those with any: an array of (start,
    ord, kind, stop, status, n_owners, n_repos) in order."""
    scanned = write_shared(scan(docs, id_col, text_col, owner_col), "secret-spans")
    some = scanned.where(F.size("base") + F.size("more") > 0)
    each = some.select("id", "v", "owner", F.explode(F.concat("base", "more")).alias("s")).select("id", "v", "owner", "s.*")
    counts = ownership(each).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = each.select("id", "v", "start", "ord", "kind", "stop", "hash").distinct().withColumn("salt", F.pmod(F.xxhash64("id", "v", "start"), F.lit(SALTS)).cast("int"))
    status = F.when((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos), "live").otherwise("example").alias("status")
    judged = salted.join(counts, ["hash", "salt"]).select("id", "v", F.struct("start", "ord", "kind", "stop", status, "n_owners", "n_repos").alias("s"))
    judged = judged.where((F.col("s.kind") != KINDS[3]) | (F.col("s.status") == "live"))
    spans = judged.groupBy("id", "v").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    return scanned.select("id", "v"), write_shared(spans, "secrets")


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with id, v) and their spans; none: an empty array."""
    kind = found.schema["spans"].dataType.simpleString()
    right = found.select(F.coalesce("id", F.lit(0)).alias("_id"), F.col("id").isNull().alias("_null"), "v", "spans")
    left = rows.withColumn("_id", F.coalesce("id", F.lit(0))).withColumn("_null", F.col("id").isNull())
    joined = join_checked(left, right, ["_id", "_null", "v"], "left", array="spans").drop("_id", "_null")
    return joined.withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {kind})")))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced: live-looking ones by ``[SECRET]``,
    widely copied examples by ``[EXAMPLE]``.  Overlapping spans become one."""
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"))
    text = F.col(f"row.`{text_col}`")
    new = replaced(text, F.col("spans"), lambda s: F.when(s["status"] == "live", "[SECRET]").otherwise("[EXAMPLE]"))
    out = with_spans(packed, found)
    return out.select([new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
