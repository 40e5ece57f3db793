"""Joins against lookup tables whose keys may be very frequent on the other side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import write_shared, written_bytes

#: Bytes of a written lookup table (compressed) that may be broadcast; beyond
#: it the join is salted.
BROADCAST_BYTES = 16 * 1024 * 1024
SALTS = 16


def _spread(df: DataFrame, salts: int) -> Column:
    """A part number by the row's content, for columns that can be hashed."""
    plain = [f.name for f in df.schema.fields if not _unhashable(f.dataType)]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.monotonically_increasing_id()
    return F.pmod(row, F.lit(salts)).cast("int")


def _unhashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_unhashable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _unhashable(dtype.elementType)
    return isinstance(dtype, (T.MapType, T.VariantType))


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Join ``facts`` with ``lookup`` on ``key``.

    The lookup is written once, which tells its size: up to ``limit`` bytes it
    is broadcast, so a hot key moves no fact row.  Beyond that every lookup row
    is repeated for ``salts`` parts and facts are dealt over the parts by a
    hash of their columns, so one key is never one task.  A key may have
    several lookup rows.  ``how`` is ``left`` or ``inner``.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"lookup_join does not do {how!r}")
    known = write_shared(lookup, "lookup")
    if written_bytes(known) <= limit:
        return facts.join(F.broadcast(known), key, how)
    dealt = facts.withColumn("__salt", _spread(facts, salts))
    many = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(many, [key, "__salt"], how).drop("__salt")
