"""Scalar column functions (U2-U16, F6 pattern translation).

All are compositions of built-in functions, so they stay inside whole-stage
code generation.  Number-to-text formatting uses ``format_number`` (ties of
exactly representable values go to even: 1.125 -> 1.12, like ``'%.2f'``).
Numeric rounding uses ``round``: HALF_UP on the decimal text of the double
(0.125 -> 0.13), a documented difference from binary round-half-even.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte units in order, and the unit after the last one.
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
BYTE_UNIT_OVERFLOW = "EB"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fixed2(x: Column) -> Column:
    """``'%.2f'`` of a double without thousands separators."""
    return F.regexp_replace(F.format_number(x.cast("double"), 2), ",", "")


def format_bytes(col: Column | str) -> Column:
    """Bytes -> ``'1.00 KB'``; null and 0 -> ``'0 B'``; works on negatives."""
    n = _c(col).cast("double")
    a = F.abs(n)
    out = F.when(n.isNull() | (n == 0), F.lit("0 B"))
    for k, unit in enumerate(BYTE_UNITS):
        out = out.when(a < F.lit(1024.0 ** (k + 1)), F.concat(fixed2(n / F.lit(1024.0**k)), F.lit(" " + unit)))
    return out.otherwise(F.concat(fixed2(n / F.lit(1024.0 ** len(BYTE_UNITS))), F.lit(" " + BYTE_UNIT_OVERFLOW)))


def format_duration(col: Column | str) -> Column:
    """Milliseconds -> two largest units, e.g. ``'1h 1m'``; null/0 -> ``'0s'``."""
    ms = _c(col).cast("bigint")
    secs = F.floor(ms / F.lit(1000))
    days = F.floor(secs / F.lit(86400))
    rem = F.pmod(secs, F.lit(86400))
    hours = F.floor(rem / F.lit(3600))
    rem = F.pmod(rem, F.lit(3600))
    minutes = F.floor(rem / F.lit(60))
    seconds = F.pmod(rem, F.lit(60))
    dp = F.when(days > 0, F.concat(days.cast("string"), F.lit("d")))
    hp = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h")))
    mp = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m")))
    sp = F.when(seconds > 0, F.concat(seconds.cast("string"), F.lit("s")))
    # the two largest non-empty parts, without arrays (stays in generated code)
    first = F.coalesce(dp, hp, mp, sp)
    second = F.when(dp.isNotNull(), F.coalesce(hp, mp, sp)).when(hp.isNotNull(), F.coalesce(mp, sp)).when(mp.isNotNull(), sp)
    return F.when(ms.isNull() | (ms == 0) | first.isNull(), F.lit("0s")).otherwise(F.concat_ws(" ", first, second))


def _with_separators(digits: Column) -> Column:
    """Thousands separators in whole-number text of any length."""
    plain = F.regexp_replace(F.regexp_replace(digits, r"^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")
    # a separator stands before every run of three digits that ends the text
    return F.regexp_replace(plain, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")


def format_count(col: Column | str) -> Column:
    """Integer text -> thousands separators; null -> ``'-'``; other text unchanged (U4)."""
    text = F.trim(_c(col).cast("string"))
    return (
        F.when(_c(col).isNull(), F.lit("-"))
        .when(text.rlike(r"^-?[0-9]+$"), _with_separators(text))
        .when(text == "", F.lit("-"))
        .otherwise(text)
    )


def nanos_to_ms(col: Column | str) -> Column:
    """Nanoseconds -> milliseconds, 3 decimals."""
    return F.round(_c(col).cast("double") / F.lit(1_000_000.0), 3)


def used_percent(used: Column | str, total: Column | str) -> Column:
    """``used / total * 100`` with 2 decimals, 0.0 when total is not positive."""
    u, t = _c(used).cast("double"), _c(total).cast("double")
    return F.when(t > 0, F.round(u / t * F.lit(100.0), 2)).otherwise(F.lit(0.0))


# What Python's str.strip() treats as white space (ASCII part).
WHITESPACE = " \t\n\r\f\u000b"


def strip_ws(col: Column) -> Column:
    """Trim white space at both ends, no regular expression."""
    return F.trim(col, F.lit(WHITESPACE))


def strip_query_string(path: Column | str) -> Column:
    return F.substring_index(strip_ws(_c(path)), "?", 1)


def target_names(path: Column | str) -> Column:
    """Index names addressed by a request path.

    First path segment split on commas; a segment starting with ``_``
    (an API endpoint) names no index; the query string is ignored.
    """
    clean = F.ltrim(strip_query_string(path), F.lit("/"))
    first = F.substring_index(clean, "/", 1)
    # split on commas with surrounding white space, drop empty names (no lambda)
    names = F.array_remove(F.split(first, r"\s*,\s*"), "")
    return F.when((first == "") | first.startswith("_") | first.isNull(), F.array().cast("array<string>")).otherwise(names)


def _last_segment(path: Column | str) -> Column:
    clean = F.lower(F.rtrim(strip_query_string(path), F.lit("/")))
    return F.substring_index(clean, "/", -1)


def drop_blank_edge_lines(text: Column, skip_first_line: bool = False) -> Column:
    """Remove leading and trailing lines that hold only white space; the
    first and last remaining lines keep their own spaces.  With
    ``skip_first_line`` the first line is dropped before that.

    One linear regular expression: blank lines are skipped possessively,
    then a greedy match runs to the end and backtracks only over the
    trailing white space to the last visible character, keeping the rest of
    that line.
    """
    ws = r"[ \t\f\u000B]"
    first = r"[^\n]*\n?" if skip_first_line else ""
    return F.regexp_extract(text, rf"(?s)^{first}(?:{ws}*\n)*+(.*\S[^\n]*)?", 1)


def is_msearch_path(path: Column | str) -> Column:
    """Last path segment is ``_msearch`` (U10, one definition for both tools)."""
    return F.coalesce(_last_segment(path) == "_msearch", F.lit(False))


def is_search_path(path: Column | str) -> Column:
    """Last path segment is ``_search``."""
    return F.coalesce(_last_segment(path) == "_search", F.lit(False))


# A JSON string (kept), or white space outside of one (dropped).
_STRING_OR_SPACE = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|[ \t\r\n]+'


def json_compact(text: Column | str) -> Column:
    """A JSON document's text without white space between its parts, null when
    it does not parse (U11).  Keys keep their order and numbers their spelling."""
    t = _c(text)
    return F.when(F.try_parse_json(t).isNotNull(), F.regexp_replace(t, _STRING_OR_SPACE, "$1"))


def strip_label(name: Column | str, labels: list[str]) -> Column:
    """Remove a trailing ``' (<label>)'`` from a query name."""
    alternatives = "|".join(re.escape(label) for label in labels)
    return F.regexp_replace(_c(name), rf" \((?:{alternatives})\)$", "")


# A glob is a row of these: a class, or one other character.
_GLOB_PART = re.compile(r"\[(?P<negated>!?)(?P<members>\]?[^\]]*)\]|(?P<single>.)", re.S)
# What a character class of Java reads as more than itself.
_CLASS_SPECIAL = set("[]\\^&-~")


def _char(c: str) -> str:
    return "\\" + c if c in _CLASS_SPECIAL else c


def _glob_class(members: str, negated: bool) -> str:
    """One character out of a glob's ``[...]``; ``a-z`` is a range, an empty
    range holds nothing."""
    parts = []
    for m in re.finditer(r"(?P<low>.)-(?P<high>.)|(?P<one>.)", members, re.S):
        if m["one"]:
            parts.append(_char(m["one"]))
        elif m["low"] <= m["high"]:
            parts.append(f"{_char(m['low'])}-{_char(m['high'])}")
    if not parts:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def glob_to_regex(pattern: str) -> str:
    """A shell glob (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored pattern.

    A bracket that is never closed stands for itself."""
    out = []
    for m in _GLOB_PART.finditer(pattern):
        if m["single"] is None:
            out.append(_glob_class(m["members"], bool(m["negated"])))
        else:
            out.append({"*": ".*", "?": "."}.get(m["single"], re.escape(m["single"])))
    return f"^(?s:{''.join(out)})$"


def matches_any_glob(col: Column | str, patterns: list[str]) -> Column:
    """True when the value matches one of the globs; false for an empty list."""
    if not patterns:
        return F.lit(False)
    regex = "|".join(glob_to_regex(p) for p in patterns)
    return F.coalesce(_c(col).rlike(regex), F.lit(False))
