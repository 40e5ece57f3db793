"""Spans in texts with DataFrame functions only, linear in the text.

Positions are code points, end exclusive.  Lengths are summed in blocks, so
that a text with very many matches stays cheap; texts are cut into blocks
before pieces are taken from them, since finding a position in a text means
walking to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.arrays import let, most_before, sums_before

#: Fixed value: characters that part words.
SPACE = r"\x20\x09-\x0D"
CHARS = 4096  #: code points of a block of text


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern, leftmost and without overlap: array of (start,
    stop, value, before, after), with the text up to the neighbouring matches."""
    one = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = one if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.struct(F.split(text, pattern, -1).alias("gap"), one.alias("all"), own.alias("value"))

    def placed(p: Column) -> Column:
        lengths = F.transform(p["all"], lambda a, i: F.length(a) + F.length(F.get(p["gap"], i)))

        def span(at: Column, i: Column) -> Column:
            start = at + F.length(F.get(p["gap"], i))
            stop = start + F.length(F.get(p["all"], i))
            return F.struct(start.alias("start"), stop.alias("stop"), F.get(p["value"], i).alias("value"), F.get(p["gap"], i).alias("before"), F.get(p["gap"], i + 1).alias("after"))

        return F.transform(sums_before(lengths), span)

    return let(parts, placed)


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with every span (start, stop; sorted) replaced by its label;
    spans that overlap an earlier one become part of it."""

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHARS).cast("int"), F.floor(b / CHARS).cast("int")
        block = F.coalesce(F.get(blocks, first), F.lit(""))
        far = F.concat(
            F.substr(block, a % CHARS + 1),
            F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.substr(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), b % CHARS),
        )
        return F.when(a >= b, F.lit("")).when(first == last, F.substr(block, a % CHARS + 1, b - a)).otherwise(far)

    def joined(p: Column) -> Column:
        spans_, blocks, before = p["spans"], p["blocks"], p["before"]

        def piece(s: Column, i: Column) -> Column:
            free = F.greatest(F.get(before, i), F.lit(0))
            return F.concat(cut(blocks, free, s["start"]), F.when(s["start"] >= free, label(s)).otherwise(F.lit("")))

        end = F.array_max(F.transform(spans_, lambda s: s["stop"]))
        return F.concat(F.array_join(F.transform(spans_, piece), ""), cut(blocks, end, p["length"]))

    parts = F.struct(
        spans.alias("spans"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0)).alias("blocks"),
        most_before(F.transform(spans, lambda s: s["stop"])).alias("before"),
        F.length(text).alias("length"),
    )
    return F.when(F.size(spans) > 0, let(parts, joined)).otherwise(text)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
