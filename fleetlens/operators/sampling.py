"""Stratified time-bucket down-sampling.

One row per (group, epoch-aligned bucket):

* the newest document of the bucket (ties broken by the larger ``_id``),
* counter fields turned into a reset-aware rate ``delta / bucket seconds``,
* latency and ratio fields as ``delta(a) / delta(b)`` between buckets,
* gauge fields replaced by their bucket maximum,
* every other field left as in the newest document (or avg / mode).

Plan shape (two exchanges, no Python):

1. ``groupBy(group…, bucket)`` with ``max_by(struct(*), struct(ts, _id))`` and
   the bucket maxima.  The partial aggregate runs before the shuffle, so a hot
   group that holds a third of the input is collapsed map-side.
2. one ``Window`` partitioned by the group and ordered by bucket carries the
   previous non-null value of every counter.  After step 1 a group holds at
   most one row per bucket, so the largest window partition is bounded by
   ``time range / interval``, not by the input size.  Where that is still too
   long for one task, ``carry_block`` cuts every series into blocks of so many
   buckets that are finished independently (:func:`_carry_by_block`).

The result does not depend on partitioning or on how the time range is cut.

``max_by`` over a struct keeps a variable-width buffer, so step 1 is planned
as a ``SortAggregate``: each map task sorts its own rows by (group, bucket)
and emits one row per key before the shuffle.  The alternatives were
weighed: ``row_number() = 1`` also sorts and cannot carry the bucket maxima,
and a hash aggregate of the maxima joined back to the newest rows would
shuffle the input twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.nested import field_type, leaf_paths, project_paths, quote_path, with_paths
from fleetlens.functions.timeutil import bucket_start_ms, epoch_micros, parse_interval_ms

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class FieldRules:
    """How classified fields are derived.  Paths are dotted."""

    rate: tuple[str, ...] = ()
    # output path -> (time path, count path)
    latency: dict[str, tuple[str, str]] = field(default_factory=dict)
    # output path -> (numerator path, denominator path)
    ratio: dict[str, tuple[str, str]] = field(default_factory=dict)
    max: tuple[str, ...] = ()

    def only(self, fields: list[str]) -> FieldRules:
        """The rules whose result lies at or below one of ``fields``."""

        def wanted(path: str) -> bool:
            return any(path == f or path.startswith(f + ".") or f.startswith(path + ".") for f in fields)

        return FieldRules(
            rate=tuple(p for p in self.rate if wanted(p)),
            latency={p: pair for p, pair in self.latency.items() if wanted(p)},
            ratio={p: pair for p, pair in self.ratio.items() if wanted(p)},
            max=tuple(p for p in self.max if wanted(p)),
        )

    def inputs(self) -> list[str]:
        seen: list[str] = []
        for path in list(self.rate) + [p for pair in self.latency.values() for p in pair] + [
            p for pair in self.ratio.values() for p in pair
        ]:
            if path not in seen:
                seen.append(path)
        return seen


def _as_double(df: DataFrame, path: str) -> Column:
    dtype = field_type(df.schema, path)
    if dtype is None:
        return F.lit(None).cast("double")
    if isinstance(dtype, T.BooleanType):
        return F.col(quote_path(path)).cast("double")
    if isinstance(dtype, NUMERIC):
        return F.col(quote_path(path)).cast("double")
    return F.expr(f"try_cast({quote_path(path)} AS DOUBLE)")


def resolve_group_columns(df: DataFrame, candidates: list[str], fixed: bool = False) -> list[str]:
    """Group columns for sampling.

    ``fixed`` keeps the candidates as given (node and index stats).  Otherwise
    a candidate is kept when the schema has it and at least one row holds a
    value: one aggregate over the candidate columns alone.  If none qualifies,
    the first candidate is used.
    """
    if fixed:
        return list(candidates)
    present = [c for c in candidates if field_type(df.schema, c) is not None]
    if not present:
        return candidates[:1]
    found = df.agg(*[F.max(F.col(quote_path(c)).isNotNull()).alias(f"c{i}") for i, c in enumerate(present)]).first()
    return [c for c, some in zip(present, found, strict=True) if some] or candidates[:1]


def add_bucket(df: DataFrame, interval: str | int, ts_col: str = "timestamp", bucket_col: str = "bucket_ms") -> DataFrame:
    """Epoch-aligned UTC bucket start in milliseconds (A2)."""
    return df.withColumn(bucket_col, bucket_start_ms(epoch_micros(df, ts_col), parse_interval_ms(interval)))


def latest_per_bucket(
    df: DataFrame,
    group_cols: list[str],
    interval: str | int,
    ts_col: str = "timestamp",
    id_col: str = "_id",
    bucket_col: str = "bucket_ms",
    drop_null_groups: bool = True,
) -> DataFrame:
    """Newest row per (group, bucket) via ``row_number``.

    Planned as a ``Window`` with partial and final ``WindowGroupLimit``; use it
    when no bucket maxima are needed.
    """
    base = _prepare(df, group_cols, drop_null_groups)
    base = add_bucket(base, interval, ts_col, bucket_col)
    w = Window.partitionBy(*[F.col(quote_path(g)) for g in group_cols], F.col(bucket_col)).orderBy(
        F.col(ts_col).desc(), F.col(id_col).desc()
    )
    return base.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def _prepare(df: DataFrame, group_cols: list[str], drop_null_groups: bool) -> DataFrame:
    if drop_null_groups and group_cols:
        cond = None
        for g in group_cols:
            c = F.col(quote_path(g)).isNotNull()
            cond = c if cond is None else cond & c
        df = df.where(cond)
    return df


def _with_modes(grouped: DataFrame, texts: DataFrame, places: list[int]) -> DataFrame:
    """Add ``__fb<i>``, the most frequent text (ties: the one that sorts first)
    of column ``__t<i>`` per key.  Values are counted first, so a bucket's
    distinct texts are rows and not one aggregate's buffer."""
    keys = [c for c in texts.columns if not c.startswith("__t")]
    long = texts.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), F.col(f"__t{i}").alias("__text")) for i in places])))
    counted = long.where("__text is not null").groupBy(*keys, "__i", "__text").agg(F.count(F.lit(1)).alias("__n"))
    best = counted.groupBy(*keys).agg(*[F.min(F.when(F.col("__i") == i, F.struct((-F.col("__n")).alias("n"), F.col("__text").alias("t")))).alias(f"__b{i}") for i in places])
    best = best.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)], *[F.col(f"__b{i}.t").alias(f"__fb{i}") for i in places])
    same = [F.col(k).eqNullSafe(F.col(f"__k{j}")) for j, k in enumerate(keys)]
    return grouped.join(best, same, "left").drop(*[f"__k{j}" for j in range(len(keys))])


def _before(series: list[str], order: str) -> Window:
    return Window.partitionBy(*series).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _carry_by_block(
    rows: DataFrame, newest: DataFrame, series: list[str], bucket_col: str, block: Column, looked: dict[str, Column], null_series: bool
) -> DataFrame:
    """``rows`` with the last non-null value of every ``looked`` column in the
    buckets before, as a window over the whole series gives it (W1).

    A scan in two levels.  Inside a block of time a window over (series, block)
    looks back.  What the blocks before left is a row per (series, block),
    aggregated from ``newest`` (the series, the bucket and the counters alone,
    so that its scan reads nothing else) and carried over the few blocks of a
    series.  The join back is on the window's own keys: the rows keep their
    partitioning, and a series with any number of buckets is spread over as
    many tasks as it has blocks.
    """
    block = block.alias("__block")
    local = rows.select("*", block)
    inner = _before([*series, "__block"], bucket_col)
    local = local.select("*", *[F.last(c, ignorenulls=True).over(inner).alias(f"{name}_in") for name, c in looked.items()])
    # by the parts of a pair: numbers aggregate without sorting
    parts = {name: [""] if name.startswith("__prev") else ["a", "b"] for name in looked}
    left = newest.select("*", block, *[c.alias(name) for name, c in looked.items()])
    last = [
        F.max_by(F.col(name + (f".{part}" if part else "")), F.when(F.col(name).isNotNull(), F.col(bucket_col))).alias(f"{name}_{part}")
        for name in looked
        for part in parts[name]
    ]
    summary = left.groupBy(*series, "__block").agg(*last)
    carry = _before(series, "__block")
    carried = summary.select(
        *[F.col(g).alias(f"{g}_key") for g in series],
        F.col("__block").alias("__block_key"),
        *[F.last(f"{name}_{part}", ignorenulls=True).over(carry).alias(f"{name}_{part}") for name in looked for part in parts[name]],
    )

    def same(c: str) -> Column:
        return F.col(c).eqNullSafe(F.col(f"{c}_key")) if null_series else F.col(c) == F.col(f"{c}_key")

    joined = local.join(carried, [same(c) for c in [*series, "__block"]], "left")

    def value(name: str) -> Column:
        before = F.col(f"{name}_") if parts[name] == [""] else F.when(F.col(f"{name}_a").isNotNull(), F.struct(F.col(f"{name}_a").alias("a"), F.col(f"{name}_b").alias("b")))
        return F.coalesce(F.col(f"{name}_in"), before).alias(name)

    return joined.select(*rows.columns, *[value(name) for name in looked])


def sample_buckets(
    df: DataFrame,
    group_cols: list[str],
    interval: str | int | None,
    rules: FieldRules | None = None,
    ts_col: str = "timestamp",
    id_col: str = "_id",
    bucket_col: str = "bucket_ms",
    fallback: str = "latest",
    drop_null_groups: bool = True,
    fields: list[str] | None = None,
    carry_block: int | None = None,
    layout: tuple[str, str] | None = None,
) -> DataFrame:
    """Down-sample ``df`` to one row per (group, bucket).

    ``carry_block`` finishes blocks of so many buckets of one series in tasks
    of their own; the rows are the same with and without it.  ``layout`` names
    two columns that the input is stored by, one that follows from the group
    and one that follows from the bucket (a block of time): rows are grouped by
    them as well, which needs no exchange, and counters are carried by them.

    ``fields`` names the paths wanted in the result: only they, the group, the
    time, the id and the inputs of rules that make them are read and moved.

    ``interval=None`` returns ``df`` unchanged: sampling without an interval
    is a full export (A13).  ``fallback="avg_mode"`` replaces unclassified
    numeric leaves by their bucket average and string leaves by their most
    frequent value (the documented variant, A9); ``"latest"`` keeps the
    newest document's value (A7).
    """
    if interval is None:
        return df
    if fallback not in ("latest", "avg_mode"):
        raise ValueError(f"unknown fallback {fallback!r}")
    rules = rules or FieldRules()
    interval_ms = parse_interval_ms(interval)
    seconds = interval_ms / 1000.0
    if fields is not None:
        rules = rules.only(fields)
        df = project_paths(df, [*group_cols, ts_col, id_col, *fields, *rules.inputs(), *rules.max, *(layout or ())])

    base = _prepare(df, group_cols, drop_null_groups)
    base = base.withColumn(bucket_col, bucket_start_ms(epoch_micros(base, ts_col), interval_ms))
    top_cols = [c for c in df.columns]

    # A bucket maximum is taken of numbers alone; any other type keeps
    # the newest document's value, decided from the schema.
    max_paths = [p for p in rules.max if isinstance(field_type(df.schema, p), NUMERIC)]

    aggs = [
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in top_cols]), F.struct(F.col(ts_col), F.col(id_col))).alias("__snap")
    ]
    aggs += [F.max(_as_double(base, p)).alias(f"__max{i}") for i, p in enumerate(max_paths)]

    fallback_paths: list[tuple[str, str]] = []
    if fallback == "avg_mode":
        classified = set(rules.max) | set(rules.rate) | set(rules.latency) | set(rules.ratio)
        skip = set(group_cols) | {ts_col, id_col, bucket_col}
        for path, dtype in leaf_paths(df.schema):
            if path in classified or path in skip:
                continue
            if isinstance(dtype, NUMERIC):
                aggs.append(F.avg(F.col(quote_path(path))).alias(f"__fb{len(fallback_paths)}"))
                fallback_paths.append((path, "avg"))
            elif isinstance(dtype, T.StringType):
                fallback_paths.append((path, "mode"))

    keys = [F.col(quote_path(g)).alias(f"__g{i}") for i, g in enumerate(group_cols)] + [F.col(bucket_col)]
    keys = [F.col(c).alias(f"__l{i}") for i, c in enumerate(layout or ())] + keys
    grouped = base.groupBy(*keys).agg(*aggs)
    modes = [(i, path) for i, (path, kind) in enumerate(fallback_paths) if kind == "mode"]
    if modes:
        grouped = _with_modes(grouped, base.select(*keys, *[F.col(quote_path(p)).alias(f"__t{i}") for i, p in modes]), [i for i, _ in modes])
    extra = [f"__max{i}" for i in range(len(max_paths))] + [f"__fb{i}" for i in range(len(fallback_paths))]
    sampled = grouped.select(
        *[F.col(f"__g{i}") for i in range(len(group_cols))], *[F.col(f"__l{i}") for i in range(len(layout or ()))], "__snap.*", F.col(bucket_col), *extra
    )

    overrides: dict[str, Column] = {}
    for i, (path, _kind) in enumerate(fallback_paths):
        overrides[path] = F.col(f"__fb{i}")

    inputs = rules.inputs()
    pairs = {**rules.latency, **rules.ratio}
    if inputs:
        cur = {p: F.col(f"__cur{i}") for i, p in enumerate(inputs)}
        sampled = sampled.select("*", *[_as_double(sampled, p).alias(f"__cur{i}") for i, p in enumerate(inputs)])

        def both(a: str, b: str) -> Column:
            return F.when(cur[a].isNotNull() & cur[b].isNotNull(), F.struct(cur[a].alias("a"), cur[b].alias("b")))

        # a rate looks back to its field's last value, a quotient to the last
        # bucket that had both inputs, so both deltas span the same time
        looked = {f"__prev{i}": cur[p] for i, p in enumerate(rules.rate)}
        looked |= {f"__pair{i}": both(a, b) for i, (a, b) in enumerate(pairs.values())}
        series = [f"__g{i}" for i in range(len(group_cols))]
        if carry_block or layout:
            block = F.col("__l1") if layout else F.floor(F.col(bucket_col) / (interval_ms * carry_block))
            if layout:
                series = ["__l0", *series]
            values = F.struct(*[_as_double(base, p).alias(f"__cur{i}") for i, p in enumerate(inputs)])
            newest = base.groupBy(*keys).agg(F.max_by(values, F.struct(F.col(ts_col), F.col(id_col))).alias("__v")).select("*", "__v.*").drop("__v")
            sampled = _carry_by_block(sampled, newest, series, bucket_col, block, looked, not drop_null_groups)
        else:
            win = _before(series, bucket_col)
            sampled = sampled.select("*", *[F.last(c, ignorenulls=True).over(win).alias(name) for name, c in looked.items()])

        def delta(now: Column, before: Column) -> Column:
            return F.when(now < before, now).otherwise(now - before)

        for i, p in enumerate(rules.rate):
            before = F.col(f"__prev{i}")
            overrides[p] = F.when(before.isNull(), cur[p]).otherwise(delta(cur[p], before) / F.lit(seconds))
        for i, (out, (a, b)) in enumerate(pairs.items()):
            before = F.col(f"__pair{i}")
            present = cur[a].isNotNull() & cur[b].isNotNull() & before.isNotNull()
            below = delta(cur[b], before["b"])
            kept = _as_double(sampled, out) if field_type(df.schema, out) is not None else F.lit(None).cast("double")
            overrides[out] = F.when(present, F.when(below == 0, F.lit(0.0)).otherwise(delta(cur[a], before["a"]) / below)).otherwise(kept)

    for i, p in enumerate(max_paths):
        overrides[p] = F.coalesce(F.col(f"__max{i}"), _as_double(sampled, p))

    result = with_paths(sampled, overrides) if overrides else sampled
    helper = [c for c in result.columns if c.startswith("__")]
    ordered = [c for c in top_cols if c in result.columns] + [bucket_col]
    ordered += [c for c in result.columns if c not in ordered and c not in helper]
    return result.select(*[F.col(f"`{c}`") for c in ordered])
