"""Document shaping: project, slim, mask, flatten.

Each operator is one pass of the schema walk in ``functions.nested``: a single
projection, no Python per row.  VARIANT values are rewritten through
their JSON text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.arrays import let
from fleetlens.functions.jsontext import drop_members, drop_scalar_members, has_whole_double, keep_paths, replace_in_json_strings
from fleetlens.functions.nested import flatten, project_paths, rewrite
from fleetlens.session import write_shared

# What slim mode removes.
SLIM_TOP_LEVEL = ("_id", "agent")
SLIM_METADATA_KEYS = ("category", "datatype", "name")
SLIM_HUMAN_READABLE_KEYS = ("store", "estimated_size", "limit_size")

# IPv4 address with explicit ASCII word boundaries, so the result does not
# depend on the JVM's definition of \b.  The first two octets are hidden.  What
# stands before is looked at from the first digit, not from every character.
IPV4_PATTERN = r"[0-9](?<![0-9A-Za-z_][0-9])[0-9]{0,2}\.[0-9]{1,3}\.([0-9]{1,3})\.([0-9]{1,3})(?![0-9A-Za-z_])"
IPV4_REPLACEMENT = "*.*.$1.$2"


def mask_ipv4(col: Column | str) -> Column:
    """``192.168.1.1`` -> ``*.*.1.1`` inside any text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, IPV4_PATTERN, IPV4_REPLACEMENT)


def _through_json(value: Column, change: Callable[[Column], Column]) -> Column:
    """A VARIANT whose JSON text was changed."""
    return F.parse_json(change(F.to_json(value)))


def _mask_leaf(_path: str, dtype: T.DataType, value: Column) -> Column:
    if isinstance(dtype, T.VariantType):
        return _through_json(value, lambda text: replace_in_json_strings(text, IPV4_PATTERN, IPV4_REPLACEMENT))
    if isinstance(dtype, T.StringType):
        return mask_ipv4(value)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        return F.transform(value, mask_ipv4)
    if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.StringType):
        return F.transform_values(value, lambda _k, v: mask_ipv4(v))
    return value


def mask_document(df: DataFrame) -> DataFrame:
    """Mask IPv4 addresses in every string at any depth; keys untouched."""
    return rewrite(df, leaf=_mask_leaf)


@dataclass(frozen=True)
class SlimConfig:
    enabled: bool = False
    remove_meta: bool = True
    remove_human_readable: bool = True


def slim_document(df: DataFrame, config: SlimConfig) -> DataFrame:
    """Drop fields that carry nothing for diagnosis.

    Metadata part: top-level ``_id`` and ``agent``, ``metadata.category``,
    ``metadata.datatype`` and ``metadata.name``.  Human-readable part: keys
    ``store``, ``estimated_size`` and ``limit_size`` below the top level, at
    any depth and inside arrays, when their value is a scalar; an object such
    as ``indices.store`` keeps its byte counts.  With the metadata part on,
    the metadata subtree is exempt from the human-readable part.  Both parts
    reach into VARIANT values as well.
    """
    if not config.enabled:
        return df

    def drop(path: str, dtype: T.DataType) -> bool:
        parts = path.split(".")
        if config.remove_meta:
            if len(parts) == 1 and parts[0] in SLIM_TOP_LEVEL:
                return True
            if parts[0] == "metadata":
                return len(parts) == 2 and parts[1] in SLIM_METADATA_KEYS
        if config.remove_human_readable and len(parts) > 1 and parts[-1] in SLIM_HUMAN_READABLE_KEYS:
            scalar = not isinstance(dtype, (T.StructType, T.MapType, T.ArrayType))
            return scalar
        return False

    def leaf(path: str, dtype: T.DataType, value: Column) -> Column:
        if not isinstance(dtype, T.VariantType):
            return value
        if config.remove_meta and path.split(".")[0] == "metadata":
            return drop_members(value, list(SLIM_METADATA_KEYS)) if path == "metadata" else value
        if config.remove_human_readable:
            return _through_json(value, lambda text: drop_scalar_members(text, list(SLIM_HUMAN_READABLE_KEYS), compact=True))
        return value

    return rewrite(df, leaf=leaf, drop=drop)


def shape_documents(
    df: DataFrame,
    source_fields: list[str] | None = None,
    mask: bool = False,
    slim: SlimConfig | None = None,
) -> DataFrame:
    """Mask, then slim, then project (P5, T10: projection is applied last and strictly)."""
    out = df
    if mask:
        out = mask_document(out)
    if slim is not None:
        out = slim_document(out, slim)
    if source_fields:
        out = project_paths(out, source_fields)
    return out


def _json_pairs(v: Column, key: Column, depth: int) -> Column:
    """Array of (key, value, more) of a VARIANT, objects descended ``depth``
    levels; ``more`` marks an object that is still to be descended."""
    kind = F.schema_of_variant(v)
    obj = F.try_variant_get(v, "$", "map<string,variant>")
    text = F.when(kind == "STRING", F.variant_get(v, "$", "string")).otherwise(F.to_json(v))
    leaf = F.array(F.struct(key.alias("key"), text.alias("value"), obj.isNotNull().alias("more")))
    if depth == 0:
        return leaf
    children = F.flatten(
        F.transform(
            F.map_entries(obj),
            lambda e: _json_pairs(e["value"], F.when(key == "", e["key"]).otherwise(F.concat(key, F.lit("."), e["key"])), depth - 1),
        )
    )
    return F.when(obj.isNotNull(), children).otherwise(leaf)


def shape_variant(document: Column, source_fields: list[str] | None = None, mask: bool = False, slim: SlimConfig | None = None) -> Column:
    """:func:`shape_documents` for a whole document held in one VARIANT."""
    out = _mask_leaf("", T.VariantType(), document) if mask else document
    if slim is not None and slim.enabled:

        def slimmed(key: Column, value: Column) -> Column:
            cut = value
            if slim.remove_human_readable:
                cut = _through_json(value, lambda text: drop_scalar_members(text, list(SLIM_HUMAN_READABLE_KEYS), compact=True))
            if slim.remove_meta:
                cut = F.when(key == "metadata", drop_members(value, list(SLIM_METADATA_KEYS))).otherwise(cut)
            return cut

        gone = list(SLIM_TOP_LEVEL) if slim.remove_meta else []
        members = F.map_filter(F.variant_get(out, "$", "map<string,variant>"), lambda key, _v: ~key.isin(gone))
        out = F.to_variant_object(F.transform_values(members, slimmed))
    return keep_paths(out, source_fields) if source_fields else out


def shape_variant_text(document: Column, source_fields: list[str] | None = None, mask: bool = False, slim: SlimConfig | None = None) -> Column:
    """JSON text of :func:`shape_variant` of an object, its members written once
    and changed as texts.  A whole double is written as an integer once its text
    was parsed again; documents that hold one, and cut ones, take that way."""
    shaped = F.to_json(shape_variant(document, source_fields, mask, slim))
    slim = slim if slim is not None and slim.enabled else SlimConfig(remove_meta=False, remove_human_readable=False)
    if source_fields or not (mask or slim.enabled):
        return shaped

    def text(key: Column, value: Column) -> Column:
        is_meta = key == "metadata"
        out = F.to_json(F.when(is_meta, drop_members(value, list(SLIM_METADATA_KEYS))).otherwise(value) if slim.remove_meta else value)
        if mask:
            out = replace_in_json_strings(out, IPV4_PATTERN, IPV4_REPLACEMENT)
        if slim.remove_human_readable:
            short = partial(drop_scalar_members, names=list(SLIM_HUMAN_READABLE_KEYS), compact=True)
            out = let(out, lambda t: F.when(is_meta, t).otherwise(short(t))) if slim.remove_meta else short(out)
        return F.concat(F.to_json(key.cast("variant")), F.lit(":"), out)

    members = F.map_entries(F.variant_get(document, "$", "map<string,variant>"))
    if slim.remove_meta:
        members = F.filter(members, lambda e: ~e["key"].isin(*SLIM_TOP_LEVEL))
    texts = F.transform(members, lambda e: text(e["key"], e["value"]))
    whole = F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))
    return let(whole, lambda t: F.when(has_whole_double(t), shaped).otherwise(t))


def _flatten(df: DataFrame, id_cols: list[str], variant: Column, braces: Column, prefix: str, levels: int) -> DataFrame:
    """``braces`` is the number of opening braces in a document's text: nothing
    is deeper than that, so one cheap aggregate tells whether ``levels`` do."""
    pairs = df.where(variant.isNotNull()).select(*id_cols, F.inline(_json_pairs(variant, F.lit(prefix), levels)))
    if (df.agg(F.max(braces)).first()[0] or 0) <= levels:
        return pairs.drop("more")
    done = []
    while True:  # deeper objects, ``levels`` at a time
        pairs = write_shared(pairs, "flatten")
        done.append(pairs.where(~F.col("more")).drop("more"))
        rest = pairs.where("more")
        if not rest.limit(1).count():
            break
        pairs = rest.select(*id_cols, F.inline(_json_pairs(F.parse_json("value"), F.col("key"), levels)))
    return reduce(DataFrame.unionByName, done)


def _braces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))


def flatten_variant(df: DataFrame, id_cols: list[str], variant: Column, prefix: str = "", levels: int = 8) -> DataFrame:
    """``flatten_json`` for a VARIANT column (e.g. a sub-document picked with ``variant_get``)."""
    return _flatten(df, id_cols, variant, _braces(F.to_json(variant)), prefix, levels)


def flatten_json(df: DataFrame, id_cols: list[str], json_col: str, prefix: str = "", levels: int = 8) -> DataFrame:
    """Free-form JSON object -> one row per leaf: ``key`` (dotted, with prefix), ``value``.

    Nested ``transform`` over the VARIANT's object entries builds the (key,
    value) pairs of ``levels`` levels inside the row, then one generator.  Only
    if some text has more opening braces than that are the pairs written and
    deeper objects taken in further passes of as many levels.  Strings keep
    their text, other leaves become JSON text; an empty object yields no rows.
    """
    return _flatten(df, id_cols, F.try_parse_json(F.col(json_col)), _braces(F.col(json_col)), prefix, levels)


__all__ = [
    "flatten_json",
    "flatten_variant",
    "SlimConfig",
    "flatten",
    "mask_document",
    "mask_ipv4",
    "project_paths",
    "shape_documents",
    "shape_variant",
    "shape_variant_text",
    "slim_document",
]
