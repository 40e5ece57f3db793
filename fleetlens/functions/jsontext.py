"""JSON text: pretty printing, rewriting strings, dropping members.

The text is cut into tokens by one linear regular expression, or changed in
place by one that finds its members and strings, so documents of any depth,
with arrays anywhere, are handled without recursion; order and spelling stay
as they are.  The same steps serve VARIANT columns, through their JSON text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.arrays import let, sums_before

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_BLANKS = r"[ \t\r\n]*+"
_WORD = r'[^ \t\r\n{}\[\],:"]++'
# A key with its colon, a string, a sign, or a number or word.
_TOKEN = rf'{_STRING}{_BLANKS}:|{_STRING}|[{{}}\[\],]|{_WORD}'
# Around an escape, and for an escaped quote; JSON text cannot hold them.
_MARK, _QUOTE = "\x01", "\x02"


def json_tokens(text: Column) -> Column:
    """Tokens of a JSON text; a key's token ends with its colon."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _opens(t: Column) -> Column:
    return t.isin("{", "[")


def _closes(t: Column) -> Column:
    return t.isin("}", "]")


def _is_key(t: Column) -> Column:
    return t.startswith('"') & t.endswith(":")


def _key_text(t: Column) -> Column:
    return F.regexp_replace(t, r"[ \t\r\n]*:$", "")


def json_pretty(text: Column | str, indent: int = 2) -> Column:
    """A JSON document over lines, ``indent`` blanks a level; null when it does
    not parse (U11).  Empty objects and arrays stay on one line; keys keep
    their order, strings and numbers their spelling."""
    t = F.col(text) if isinstance(text, str) else text

    def laid_out(p: Column) -> Column:
        tokens, depth = p["tokens"], p["depth"]

        def line(level: Column) -> Column:
            return F.concat(F.lit("\n"), F.repeat(F.lit(" "), level * indent))

        def piece(token: Column, i: Column) -> Column:
            level = F.get(depth, i)
            return (
                F.when(_opens(token), F.when(_closes(F.get(tokens, i + 1)), token).otherwise(F.concat(token, line(level + 1))))
                .when(_closes(token), F.when(_opens(F.get(tokens, i - 1)), token).otherwise(F.concat(line(level - 1), token)))
                .when(token == ",", F.concat(token, line(level)))
                .when(_is_key(token), F.concat(_key_text(token), F.lit(": ")))
                .otherwise(token)
            )

        return F.array_join(F.transform(tokens, piece), "")

    def with_depth(tokens: Column) -> Column:
        step = F.transform(tokens, lambda x: F.when(_opens(x), 1).when(_closes(x), -1).otherwise(0))
        return let(F.struct(tokens.alias("tokens"), sums_before(step).alias("depth")), laid_out)

    return F.when(F.try_parse_json(t).isNotNull(), let(json_tokens(t), with_depth))


def map_json_strings(text: Column, change: Callable[[Column], Column], maybe: str = "") -> Column:
    """JSON text with every string value (not keys) replaced by ``change`` of
    it; only strings whose JSON text matches ``maybe`` are looked at."""

    def piece(token: Column) -> Column:
        value = F.variant_get(F.try_parse_json(token), "$", "string")
        new = F.to_json(change(value).cast("variant"))
        return F.when(token.startswith('"') & ~_is_key(token) & token.rlike(maybe), new).otherwise(token)

    return F.when(text.rlike(maybe), F.array_join(F.transform(json_tokens(text), piece), "")).otherwise(text)


def has_whole_double(text: Column) -> Column:
    """Whether a number of a JSON text may end like 100.0 (strings are looked at
    too).  ``to_json`` writes this for a double alone; parsed again it is a
    decimal, written without the zero."""
    return text.contains(".0,") | text.contains(".0}") | text.contains(".0]")


def replace_in_json_strings(text: Column, pattern: str, replacement: str) -> Column:
    """JSON text as ``to_json`` writes it (no blanks, only quotes, backslashes
    and control characters escaped), with every match of ``pattern`` in its
    string values (not keys) replaced.

    ``pattern`` must match no quote or control character, and must hold such a
    character for no part of a word.  In a text with escapes these stand between
    two control characters meanwhile, so that no letter of theirs touches a match."""

    def replaced(t: Column) -> Column:
        return F.regexp_replace(t, rf'{pattern}(?![^"]*+":)', replacement)

    def careful(t: Column) -> Column:
        apart = F.regexp_replace(t, r"\\(u[0-9A-Fa-f]{4}|.)", f"{_MARK}$1{_MARK}")
        changed = replaced(F.replace(apart, F.lit(f'{_MARK}"{_MARK}'), F.lit(_QUOTE)))
        quoted = F.replace(changed, F.lit(_QUOTE), F.lit(f'{_MARK}"{_MARK}'))
        return F.regexp_replace(quoted, f"{_MARK}([^{_MARK}]++){_MARK}", r"\\$1")

    return let(text, lambda t: F.when(t.contains("\\"), careful(t)).otherwise(replaced(t)))


def drop_scalar_members(text: Column, names: list[str], compact: bool = False) -> Column:
    """JSON text without the members called ``names`` whose value is no object
    or array, at any depth.  ``compact``: a text without blanks between tokens,
    whose members are found by a literal, so that the search skips through it.

    A quote after a comma or brace that is followed by a name opens a string:
    a closing one is followed by a sign."""
    blanks = "" if compact else _BLANKS
    for name in names:
        member = rf'{blanks}"\Q{name}\E"{blanks}:{blanks}(?:{_STRING}|{_WORD})'
        text = F.regexp_replace(text, f",{member}", "")
        text = F.regexp_replace(text, rf"\{{{member}{blanks},?+", "{")
    return text


def keep_paths(value: Column, paths: list[str]) -> Column:
    """A VARIANT cut to dotted ``paths`` of object keys; a path to an object
    keeps all below it, arrays on the way are kept with their elements cut.
    What no path reaches is left out; a value where a path leads on but there
    is no object is left out too."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})
    whole = set(paths)  # a kept path covers everything below it

    def cut(v: Column, node: dict, at: str, in_array: bool = False) -> Column:
        if at in whole:
            return v
        members = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _x: k.isin(*node))

        def member(k: Column, x: Column) -> Column:
            out = x
            for name, sub in node.items():
                path = f"{at}.{name}" if at else name
                if path not in whole:
                    out = F.when(k == name, cut(x, sub, path)).otherwise(out)
            return out

        kept = F.to_variant_object(F.map_filter(F.transform_values(members, member), lambda _k, x: x.isNotNull()))
        if in_array:
            return F.when(members.isNotNull(), kept)
        elements = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: cut(x, node, at, True)), lambda x: x.isNotNull())
        return F.when(members.isNotNull(), kept).when(F.schema_of_variant(v).startswith("ARRAY"), F.to_variant_object(elements))

    return cut(value, tree, "")


def drop_members(value: Column, names: list[str]) -> Column:
    """A VARIANT object without the members called ``names``; others as they are."""
    members = F.try_variant_get(value, "$", "map<string,variant>")
    return F.when(members.isNotNull(), F.to_variant_object(F.map_filter(members, lambda k, _x: ~k.isin(*names)))).otherwise(value)
