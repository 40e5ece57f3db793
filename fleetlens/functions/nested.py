"""Nested-path helpers and the one schema-walk used by every document rewrite.

Project (P1), slim (P2/P3), mask (P4), flatten (P8) and the sampler's field
overrides (P7) all rewrite a nested schema.  They share ``rewrite``: it walks
the ``StructType`` once on the driver and emits a single Column expression per
top-level column, so the plan holds one projection and no chains of
``withField``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.jsontext import keep_paths


def quote_path(path: str) -> str:
    """``a.b.1m`` -> ``a.b.`1m``` so that dotted paths with odd names resolve."""
    return ".".join(f"`{part}`" for part in path.split("."))


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Data type at a dotted path, ``None`` when absent."""
    current: T.DataType = schema
    for part in path.split("."):
        if not isinstance(current, T.StructType) or part not in current.names:
            return None
        current = current[part].dataType
    return current


def get_path(schema: T.StructType, path: str) -> Column:
    """The value at a dotted path; null where the schema has no such path."""
    return F.lit(None) if field_type(schema, path) is None else F.col(quote_path(path))


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """All non-struct leaves with their dotted path."""
    out: list[tuple[str, T.DataType]] = []
    for field in schema.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        if isinstance(field.dataType, T.StructType):
            out.extend(leaf_paths(field.dataType, path))
        else:
            out.append((path, field.dataType))
    return out


# A visitor gets (path, data type, column) and returns a Column, or None to
# drop the field.  Struct fields are visited after their children were
# rewritten, so a visitor may still drop a whole struct.
Visitor = Callable[[str, T.DataType, Column], Column | None]


def _rewrite_value(path: str, dtype: T.DataType, value: Column, leaf: Visitor, drop: Callable[[str, T.DataType], bool]) -> Column | None:
    if isinstance(dtype, T.StructType):
        parts = []
        for field in dtype.fields:
            child_path = f"{path}.{field.name}" if path else field.name
            if drop(child_path, field.dataType):
                continue
            child = _rewrite_value(child_path, field.dataType, value.getField(field.name), leaf, drop)
            if child is not None:
                parts.append(child.alias(field.name))
        if not parts:
            return None
        # keep a null struct null instead of turning it into a struct of nulls
        return F.when(value.isNull(), F.lit(None)).otherwise(F.struct(*parts))
    if isinstance(dtype, T.ArrayType):
        if _needs_walk(dtype.elementType):
            return F.transform(value, lambda x: _rewrite_value(path, dtype.elementType, x, leaf, drop))
        return leaf(path, dtype, value)
    if isinstance(dtype, T.MapType):
        if _needs_walk(dtype.valueType):
            return F.transform_values(value, lambda _k, v: _rewrite_value(path, dtype.valueType, v, leaf, drop))
        return leaf(path, dtype, value)
    return leaf(path, dtype, value)


def _needs_walk(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def variant_above(schema: T.StructType, path: str) -> str | None:
    """The VARIANT column or field that ``path`` leads into, if any."""
    parts = path.split(".")
    for i in range(1, len(parts)):
        if isinstance(field_type(schema, ".".join(parts[:i])), T.VariantType):
            return ".".join(parts[:i])
    return None


def rewrite(
    df: DataFrame,
    leaf: Visitor | None = None,
    drop: Callable[[str, T.DataType], bool] | None = None,
) -> DataFrame:
    """Rewrite every column of ``df`` in one ``select``.

    ``leaf`` maps a non-struct value (arrays of scalars and maps of scalars
    are handed over whole, a VARIANT too) to a new Column; ``drop`` removes a
    field, at any depth, before it is visited.
    """
    leaf = leaf or (lambda _p, _t, c: c)
    drop = drop or (lambda _p, _t: False)
    cols = []
    for field in df.schema.fields:
        if drop(field.name, field.dataType):
            continue
        value = _rewrite_value(field.name, field.dataType, F.col(f"`{field.name}`"), leaf, drop)
        if value is not None:
            cols.append(value.alias(field.name))
    return df.select(*cols)


def with_paths(df: DataFrame, overrides: dict[str, Column]) -> DataFrame:
    """Set nested paths to new values in a single projection.

    Missing parents are created, existing siblings are kept.
    """
    tree: dict = {}
    for path, column in overrides.items():
        node = tree
        parts = path.split(".")
        for part in parts[:-1]:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ValueError(f"path {path} crosses a value set by another override")
        node[parts[-1]] = column

    def build(dtype: T.DataType | None, value: Column | None, node: dict) -> Column:
        parts = []
        seen = set()
        if isinstance(dtype, T.StructType):
            for field in dtype.fields:
                seen.add(field.name)
                child = value.getField(field.name)
                if field.name in node:
                    sub = node[field.name]
                    if isinstance(sub, dict):
                        parts.append(build(field.dataType, child, sub).alias(field.name))
                    else:
                        parts.append(sub.alias(field.name))
                else:
                    parts.append(child.alias(field.name))
        for name, sub in node.items():
            if name in seen:
                continue
            if isinstance(sub, dict):
                parts.append(build(None, None, sub).alias(name))
            else:
                parts.append(sub.alias(name))
        return F.struct(*parts)

    cols = []
    for field in df.schema.fields:
        if field.name in tree:
            sub = tree[field.name]
            if isinstance(sub, dict):
                cols.append(build(field.dataType, F.col(f"`{field.name}`"), sub).alias(field.name))
            else:
                cols.append(sub.alias(field.name))
        else:
            cols.append(F.col(f"`{field.name}`"))
    for name, sub in tree.items():
        if name not in df.columns:
            cols.append((build(None, None, sub) if isinstance(sub, dict) else sub).alias(name))
    return df.select(*cols)


def project_paths(df: DataFrame, paths: list[str]) -> DataFrame:
    """Keep only the listed dotted paths; a path to an object keeps its subtree.

    Unknown paths are ignored.  Column pruning then reaches the Parquet scan.
    A path that leads into a VARIANT cuts that value (:func:`keep_paths`).
    """
    inside: dict[str, list[str]] = {}
    for p in paths:
        above = variant_above(df.schema, p)
        if above is not None:
            inside.setdefault(above, []).append(p[len(above) + 1 :])
    keep = [p for p in paths if field_type(df.schema, p) is not None]
    inside = {v: below for v, below in inside.items() if not any(v == k or v.startswith(k + ".") for k in keep)}
    keep += inside

    def kept(path: str) -> bool:
        return any(path == k or path.startswith(k + ".") or k.startswith(path + ".") for k in keep)

    def cut(path: str, _t: T.DataType, value: Column) -> Column:
        return keep_paths(value, inside[path]) if path in inside else value

    return rewrite(df, leaf=cut, drop=lambda path, _t: not kept(path))


def flatten(df: DataFrame, prefix: str = "", sep: str = ".") -> DataFrame:
    """One column per leaf, named by its dotted path with an optional prefix."""
    cols = []
    for path, _dtype in leaf_paths(df.schema):
        name = f"{prefix}{sep}{path}" if prefix else path
        cols.append(F.col(quote_path(path)).alias(name))
    return df.select(*cols)
