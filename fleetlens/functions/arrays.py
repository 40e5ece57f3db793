"""Running values over array elements, in time linear in the array.

A fold that appends to an array copies it at every step.  These run in blocks,
first inside each block, then over the blocks, so long arrays stay cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256  #: array elements of a block


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` (associative, ``zero`` neutral) makes of the elements before
    each one.  ``values`` is an array of ints without nulls."""
    empty = F.expr("cast(array() as array<int>)")

    def scan(xs: Column) -> Column:
        start = F.struct(zero.alias("sum"), empty.alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(join(acc["sum"], x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))

    def whole(xs: Column) -> Column:
        count = F.floor((F.size(xs) + (BLOCK - 1)) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: scan(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, lambda b: b["sum"]))["out"], lambda b, o: F.transform(b["out"], lambda x: join(o, x)))))

    return let(values, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(empty))


def sums_before(values: Column) -> Column:
    return running(values, F.lit(0), lambda a, b: a + b)


def most_before(values: Column) -> Column:
    return running(values, F.lit(-1), lambda a, b: F.greatest(a, b))
