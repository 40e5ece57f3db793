r"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers that fixed patterns find; their spans are always reported.  Words near
an entity can give it away although they are no personal data by themselves.
How strongly is estimated from the whole corpus.  With n(t) the texts that
hold a term, n(e) those that hold an entity, n(t, e) those that hold the term
within ``reach`` characters of the entity, and N all texts,

    IC(e)     = -log2 n(e) / N                       what the entity hides
    PMI(t, e) = log2 (n(t, e) N) / (n(t) n(e))       what the term tells of it

leave IC - PMI = -log2 n(t, e) / n(t) bits hidden once the term is read.  A
term that leaves at most ``remove_bits`` of any entity is removed ("reveals"),
one that leaves at most ``generalise_bits`` is replaced by its class ("hints"),
wherever it stands in the corpus.  It takes ``support`` texts at least to
estimate a pair, and an entity that more than one text of 2**common_bits holds
hides too little to be given away.  The thresholds are in bits, so they mean
the same at every corpus size.

A term is a word between blanks that, without signs at its ends, has letters
only, ``LETTERS`` at least; small letters count.  Texts, not rows, are counted,
so exact copies do not vouch for each other.

n(t) is counted for candidates only: a term whose texts with it near any
entity are already too many for the threshold cannot pass, which rules out the
common words before the corpus is read.  Counts are partial sums before every
shuffle and keyed by (term, text) first, so neither a common word nor a common
address gathers in one task.  Texts are not shuffled unless the texts with
terms are too many ids to broadcast.

Defined results: a null or empty text has no span.  Rows that repeat an id and
text have the same spans each; rows that repeat an id with another text are
told apart by the text's hash.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import join_checked
from fleetlens.llm.spans import SPACE, matches, replaced
from fleetlens.session import write_shared

# The base patterns.  Java walks back over a run that fails from
# each of its characters, so runs are entered at their start (or where the
# match before ended) only, and repeats do not give back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

KINDS = ("email", "ip", "card", "phone", "reveals", "hints")
SPAN = "array<struct<start:int,ord:int,kind:string,stop:int>>"
LETTERS = 4
REACH = 48
TERM = rf"(?<![^{SPACE}])[^\p{{L}}\p{{N}}{SPACE}]*+(\p{{L}}{{{LETTERS},}}+)[^\p{{L}}\p{{N}}{SPACE}]*+(?![^{SPACE}])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def part(d: Column, i: Column) -> Column:
        x = d.cast("int") * (i % 2 + 1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.transform(F.reverse(F.split(digits, "")), part), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _good(kind: str, value: Column) -> Column:
    """Whether a match counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    size = F.length(_digits(value))
    if kind == "card":
        return F.when(size.between(14, 19), _luhn(_digits(value))).otherwise(False)
    return size.between(10, 15)


def _near(gap: Column, after: bool, reach: int) -> Column:
    """Whole words of a gap within ``reach`` characters of the match."""
    cut = F.length(gap) > reach
    if after:
        part = F.regexp_replace(F.substr(gap, F.lit(1), F.lit(reach)), rf"^[^{SPACE}]+", "")
        return F.when(cut, F.regexp_replace(part, rf"[^{SPACE}]+$", "")).otherwise(part)
    part = F.regexp_replace(F.when(cut, F.substr(gap, F.lit(-reach))).otherwise(gap), rf"[^{SPACE}]+$", "")
    return F.when(cut, F.regexp_replace(part, rf"^[^{SPACE}]+", "")).otherwise(part)


def _found(text: Column, ord_: int, pattern: str, maybe: Column, reach: int) -> Column:
    """Spans of one base kind with the entity's hash and the words around."""
    kind = KINDS[ord_]

    def entity(m: Column) -> Column:
        return F.lower(m["value"]) if kind == "email" else m["value"] if kind == "ip" else _digits(m["value"])

    def span(m: Column) -> Column:
        around = F.concat(_near(m["before"], False, reach), F.lit(" "), _near(m["after"], True, reach))
        return F.struct(
            m["start"].alias("start"),
            F.lit(ord_).alias("ord"),
            F.lit(kind).alias("kind"),
            m["stop"].alias("stop"),
            F.xxhash64(F.lit(kind), entity(m)).alias("entity"),
            around.alias("around"),
        )

    good = F.filter(matches(text, pattern), lambda m: _good(kind, m["value"]))
    none = F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,stop:int,entity:bigint,around:string>>)")
    return F.when(maybe, F.transform(good, span)).otherwise(none)


def scan(docs: DataFrame, id_col: str, text_col: str, reach: int = REACH) -> DataFrame:
    """Per row: id, v (hash of the text) and its base spans."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = F.concat(
        _found(text, 0, EMAIL, text.contains("@"), reach),
        _found(text, 1, IP, text.rlike(r"[0-9]\.[0-9]"), reach),
        _found(text, 2, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), reach),
        _found(text, 3, PHONE, text.rlike(r"\+[0-9]"), reach),
    )
    return rows.select("id", "v", base.alias("base"))


def candidates(scanned: DataFrame, bits: float, support: int, common_bits: float) -> DataFrame:
    """(term, n_pair): the largest n(t, e) of every term that may pass."""
    n = scanned.select("v").distinct().count()
    each = scanned.select("v", F.explode("base").alias("b")).select("v", "b.entity", "b.around")
    entities = each.select("entity", "v").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    near = each.select("entity", "v", F.explode(F.regexp_extract_all("around", F.lit(TERM), F.lit(1))).alias("term"))
    near = write_shared(near.select("entity", "v", F.lower("term").alias("term")).distinct(), "pii-near")
    pairs = near.groupBy("term", "entity").agg(F.count("*").alias("n_pair")).where(F.col("n_pair") >= support)
    # entities are joined by their hash; one entity has few terms beside it that pass the support
    hidden = pairs.join(entities.where(F.col("n_entity") * 2.0**common_bits <= n), "entity")
    best = hidden.groupBy("term").agg(F.max("n_pair").alias("n_pair"))
    least = near.select("term", "v").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    return best.join(least, "term").where(F.col("n_pair") * 2.0**bits >= F.col("n_near")).select("term", "n_pair")


def disclosing(
    docs: DataFrame,
    scanned: DataFrame,
    text_col: str = "text",
    remove_bits: float = 1.0,
    generalise_bits: float = 2.0,
    support: int = 2,
    common_bits: float = 4.0,
) -> tuple[DataFrame, DataFrame]:
    """(terms, texts): the terms over the thresholds (term, kind, n_pair,
    n_term), and the hashes v of the texts that hold any."""
    wanted = write_shared(candidates(scanned, generalise_bits, support, common_bits), "pii-candidates")
    words = docs.select(F.xxhash64(text_col).alias("v"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(TERM), F.lit(1)))).alias("term"))
    words = words.select("v", F.lower("term").alias("term"))
    held = write_shared(join_checked(words, wanted.select("term"), ["term"], "inner").distinct(), "pii-terms")
    counted = held.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term")
    kind = F.when(F.col("n_pair") * 2.0**remove_bits >= F.col("n_term"), KINDS[4]).otherwise(KINDS[5])
    terms = write_shared(counted.where(F.col("n_pair") * 2.0**generalise_bits >= F.col("n_term")).select("term", kind.alias("kind"), "n_pair", "n_term"), "pii-disclosing")
    texts = write_shared(join_checked(held, terms.select("term"), ["term"], "left_semi").select("v").distinct(), "pii-texts")
    return terms, texts


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds: float) -> tuple[DataFrame, DataFrame]:
    """(rows, terms).  ``rows`` has id, v and ``spans`` (start, ord, kind, stop;
    in order) of every row of ``docs``; ``terms`` as :func:`disclosing`."""
    scanned = write_shared(scan(docs, id_col, text_col), "pii-spans")
    terms, texts = disclosing(docs, scanned, text_col, **thresholds)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # one text of each hash: copies share their spans
    some = join_checked(rows, texts, ["v"], "left_semi")
    words = some.select("id", "v", F.explode(matches(F.col("_text"), rf"[^{SPACE}]+")).alias("w")).select("id", "v", "w.start", "w.value")
    ends = r"[^\p{L}\p{N}]*"
    own = F.regexp_extract("value", rf"^{ends}(\p{{L}}{{{LETTERS},}}){ends}$", 1)
    lead = F.length(F.regexp_extract("value", rf"^{ends}", 0))
    words = words.select("id", "v", (F.col("start") + lead).alias("start"), own.alias("own"), F.lower(own).alias("term")).where("own <> ''")
    hits = join_checked(words, terms.select("term", "kind"), ["term"], "inner")
    order = F.when(F.col("kind") == KINDS[4], 4).otherwise(5)
    span = F.struct("start", order.alias("ord"), "kind", (F.col("start") + F.length("own")).alias("stop"))
    more = write_shared(hits.select("id", "v", span.alias("s")).distinct().groupBy("id", "v").agg(F.collect_list("s").alias("more")), "pii-more")
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["ord"].alias("ord"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    left = scanned.select(F.struct("id").alias("_key"), "v", base.alias("base"))  # a struct's null id equals itself
    right = more.select(F.struct("id").alias("_key"), "v", "more")
    joined = join_checked(left, right, ["_key", "v"], "left", array="more")
    spans = F.sort_array(F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {SPAN})"))))
    return joined.select(F.col("_key.id").alias("id"), "v", spans.alias("spans")), terms


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced: base kinds and generalised terms by
    their class, removed terms by nothing."""
    packed = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("id")).alias("_key"), F.xxhash64(text_col).alias("v"))
    spans = found.where(F.size("spans") > 0).select(F.struct("id").alias("_key"), "v", "spans").dropDuplicates(["_key", "v"])
    out = join_checked(packed, write_shared(spans, "pii-spans-of"), ["_key", "v"], "left", array="spans")
    text = F.col(f"row.`{text_col}`")

    def label(s: Column) -> Column:
        return F.when(s["kind"] == KINDS[4], "").when(s["kind"] == KINDS[5], "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    new = F.when(F.size("spans") > 0, replaced(text, F.col("spans"), label)).otherwise(text)
    return out.select([new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
