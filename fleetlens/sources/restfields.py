"""JSON documents with a declared schema that lose no other field.

A line is parsed once, to VARIANT.  The declared fields are taken from it; what
the schema does not name, or what is of another kind than declared, stays in
``_rest``: per declared object, keyed by its dotted path (empty for the
document itself), the members that are left.  ``whole_document`` puts both
together again for writing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.arrays import let
from fleetlens.functions.jsontext import has_whole_double
from fleetlens.session import materialized

REST = "_rest"
MEMBERS = "map<string,variant>"
# Names around the members of ``_rest`` in a text; no document uses such names.
_FROM, _TO = "\x01rest", "\x01end"


def _objects(schema: T.StructType, parts: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.StructType]]:
    """Names leading to, and schema of, every declared object."""
    out = [(parts, schema)]
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += _objects(f.dataType, (*parts, f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)) and "struct<" in f.dataType.simpleString():
            # elements have no place of their own in ``_rest``
            raise ValueError(f"{f.name}: objects inside arrays or maps cannot keep undeclared fields; declare them as VARIANT")
    return out


def _ddl(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StructType):
        return "struct<" + ",".join(f"`{f.name}`:{_ddl(f.dataType)}" for f in dtype.fields) + ">"
    return dtype.simpleString()


def _text(value: str) -> str:
    """A SQL text literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _left_over(parts: tuple[str, ...], dtype: T.StructType) -> str:
    """Members of the object at ``parts`` of the document ``v`` that the declared
    columns, read as ``d``, do not hold.  (SQL text: a schema has hundreds of fields.)"""
    at = "$" + "".join(f'["{part}"]' for part in parts)
    own = ".".join(["d", *(f"`{part}`" for part in parts)])
    members = f"try_variant_get(v, {_text(at)}, '{MEMBERS}')"
    other = f"k NOT IN ({', '.join(map(_text, dtype.names))})"
    unread = [f"{own}.`{name}` IS NULL" for name in dtype.names]
    each = " ".join(f"WHEN {_text(name)} THEN {null}" for name, null in zip(dtype.names, unread, strict=True))
    # only where some declared field reads null can it be of another kind
    some = f"map_filter({members}, (k, x) -> {other} OR (NOT is_variant_null(x) AND CASE k {each} END))"
    return f"CASE WHEN {' OR '.join(unread)} THEN {some} ELSE map_filter({members}, (k, x) -> {other}) END"


def read_with_rest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines as the declared columns and ``_rest``.

    A declared field that is missing or of another kind reads null.  Lines
    that hold no JSON object are left out, blank ones too.
    """
    objects = _objects(schema)
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"))
    # a line is parsed and read once, however often the declared fields are filtered by
    parsed = materialized(lines.select("v", F.try_variant_get("v", "$", _ddl(schema)).alias("d"))).where(F.col("d").isNotNull())
    levels = F.array(*[F.struct(F.lit(".".join(parts)).alias("key"), F.expr(_left_over(parts, dtype)).alias("value")) for parts, dtype in objects])
    rest = F.map_from_entries(F.filter(levels, lambda e: F.size(e["value"]) > 0))
    return parsed.select("d.*", rest.alias(REST))


def whole_document(df: DataFrame) -> Column:
    """The document of a row read by :func:`read_with_rest` as one VARIANT: the
    columns, nulls included, with the members of ``_rest`` in their places.

    The members are written as the last ones of their objects, in one text that
    is parsed once.  Where a member stands for a declared field (two of a name
    do not parse), or is a whole double (which the text would turn into an
    integer), both are merged value by value instead."""
    schema = T.StructType([f for f in df.schema.fields if f.name != REST])

    def with_members(parts: tuple[str, ...], dtype: T.StructType) -> str:
        own = {f.name: ".".join(f"`{part}`" for part in (*parts, f.name)) for f in dtype.fields}
        fields = [f"{_text(f.name)}, {with_members((*parts, f.name), f.dataType) if isinstance(f.dataType, T.StructType) else own[f.name]}" for f in dtype.fields]
        more = f"try_element_at(`{REST}`, {_text('.'.join(parts))})"
        struct = f"named_struct({', '.join(fields)}, {_text(_FROM)}, {more}, {_text(_TO)}, 0)"
        return f"CASE WHEN {'.'.join(f'`{part}`' for part in parts)} IS NOT NULL THEN {struct} END" if parts else struct

    def parsed(text: Column) -> Column:
        plain = text
        # literals one by one: their search skips through the text
        for mark in (f',"{_FROM}":null,"{_TO}":0', f'"{_FROM}":{{', f'}},"{_TO}":0'):
            plain = F.regexp_replace(plain, r"\Q" + mark.replace("\x01", r"\u0001") + r"\E", "")
        return F.when(~(has_whole_double(text) & has_whole_double(F.to_json(REST))), F.try_parse_json(plain))

    text = F.expr(f"to_json({with_members((), schema)}, map('ignoreNullFields', 'false'))")
    return F.coalesce(let(text, parsed), _merged(schema))


def _merged(schema: T.StructType) -> Column:
    """The same document, object by object; right for any members."""
    columns = ", ".join(f"`{c}`" for c in schema.names)
    declared = f"parse_json(to_json(struct({columns}), map('ignoreNullFields', 'false')))"

    def merged(value: str, path: str, dtype: T.StructType, depth: int) -> str:
        members = f"try_variant_get({value}, '$', '{MEMBERS}')"
        more = f"coalesce(try_element_at(`{REST}`, {_text(path)}), cast(map() AS {MEMBERS}))"
        k, x = f"k{depth}", f"x{depth}"
        objects = [f for f in dtype.fields if isinstance(f.dataType, T.StructType)]
        if objects:
            inner = " ".join(f"WHEN {_text(f.name)} THEN {merged(x, f'{path}.{f.name}' if path else f.name, f.dataType, depth + 1)}" for f in objects)
            members = f"transform_values({members}, ({k}, {x}) -> CASE {k} {inner} ELSE {x} END)"
        kept = f"map_filter({members}, (k, x) -> NOT array_contains(map_keys({more}), k))"
        return f"coalesce(to_variant_object(map_concat({kept}, {more})), {value})"

    return F.element_at(F.expr(f"transform(array({declared}), d -> {merged('d', '', schema, 0)})"), 1)
