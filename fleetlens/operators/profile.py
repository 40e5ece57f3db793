"""Search-profile roll-up.

A profile is one response's ``shards[].searches[].{query[], collector[],
rewrite_time}``, ``shards[].fetch`` and ``shards[].aggregations[]``.  Totals
and rankings (slowest shard, top components, collectors and phases) are computed
inside the row with array functions: a profile is one row, so nothing is
shuffled.  ``id_col`` names a profile in the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import nanos_to_ms


def _non_null(arr: Column) -> Column:
    return F.filter(F.coalesce(arr, F.array()), lambda x: x.isNotNull())


def _flat(arr_of_arrays: Column) -> Column:
    """``flatten`` that treats a missing inner array as empty."""
    return F.flatten(_non_null(arr_of_arrays))


def _total(longs: Column) -> Column:
    return F.aggregate(F.coalesce(longs, F.array()), F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x, F.lit(0)).cast("bigint"))


def profile_rollup(profiles: DataFrame, id_col: str = "run_id", profile_col: str = "profile") -> DataFrame:
    """Per profile: shard count and total query / fetch / aggregation / rewrite ms.

    Nested fields are reached with array field extraction and ``flatten``
    (generated code); only flat sums use a lambda.
    """
    shards = F.coalesce(F.col(f"{profile_col}.shards"), F.array())
    searches = _flat(shards.getField("searches"))
    return profiles.select(
        id_col,
        F.size(shards).alias("shard_count"),
        nanos_to_ms(_total(_flat(searches.getField("query")).getField("time_in_nanos"))).alias("total_query_time_ms"),
        nanos_to_ms(_total(shards.getField("fetch").getField("time_in_nanos"))).alias("total_fetch_time_ms"),
        nanos_to_ms(_total(_flat(shards.getField("aggregations")).getField("time_in_nanos"))).alias("total_aggregation_time_ms"),
        nanos_to_ms(_total(searches.getField("rewrite_time"))).alias("total_rewrite_time_ms"),
    ).where(F.col("shard_count") > 0)


def _staged(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``df``'s columns ``keep`` and the ``made`` ones, computed once: what comes
    through a generator is not built again inside later expressions."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def _per_shard(shards: Column) -> Column:
    """Per shard its times in nanoseconds, in document order."""

    def one(s: Column, i: Column) -> Column:
        searches = F.coalesce(s["searches"], F.array())
        q = _total(_flat(searches.getField("query")).getField("time_in_nanos"))
        fetch = F.coalesce(s["fetch"]["time_in_nanos"], F.lit(0)).cast("bigint")
        aggs = _total(s["aggregations"].getField("time_in_nanos"))
        rewrite = _total(searches.getField("rewrite_time"))
        return F.struct(s["id"].alias("shard_id"), s["index"].alias("index"), s["node_id"].alias("node_id"), q.alias("q"), fetch.alias("f"), aggs.alias("a"), rewrite.alias("r"))

    return F.transform(shards, one)


def _slowest_place(per: Column) -> Column:
    """Place of the shard with the largest total; the first of equal ones."""
    return -F.array_max(F.transform(per, lambda x, i: F.struct((x["q"] + x["f"] + x["a"]).alias("t"), (-i).alias("order"))))["order"]


def _slowest_record(x: Column) -> Column:
    return F.struct(
        x["shard_id"].alias("shard_id"),
        x["index"].alias("index"),
        x["node_id"].alias("node_id"),
        nanos_to_ms(x["q"] + x["f"] + x["a"]).alias("total_time_ms"),
        nanos_to_ms(x["q"]).alias("query_time_ms"),
        nanos_to_ms(x["f"]).alias("fetch_time_ms"),
        nanos_to_ms(x["a"]).alias("aggregation_time_ms"),
        nanos_to_ms(x["r"]).alias("rewrite_time_ms"),
    )


def _top_listed(shards: Column, listed: str, fields: tuple[str, ...], k: int) -> Column:
    """The ``k`` entries of every search's list ``listed`` with the largest
    time; times are rounded first, ties keep document order."""

    def entries(s: Column, i: Column) -> Column:
        return F.flatten(
            F.transform(
                F.coalesce(s["searches"], F.array()),
                lambda se, j: F.transform(
                    F.coalesce(se[listed], F.array()),
                    lambda e, n: F.struct(
                        (-nanos_to_ms(F.coalesce(e["time_in_nanos"], F.lit(0)))).alias("order"),
                        i.alias("i"),
                        j.alias("j"),
                        n.alias("n"),
                        *[e[f].alias(f) for f in fields],
                        nanos_to_ms(F.coalesce(e["time_in_nanos"], F.lit(0))).alias("time_ms"),
                        s["id"].alias("shard"),
                        s["index"].alias("index"),
                    ),
                ),
            )
        )

    ranked = F.slice(F.array_sort(F.flatten(F.transform(shards, entries))), 1, k)
    return F.transform(ranked, lambda x, r: F.struct((r + 1).alias("rank"), *[x[f].alias(f) for f in (*fields, "time_ms", "shard", "index")]))


def _phase_entries(shards: Column) -> Column:
    """The breakdown entries of all queries; ``*_count`` entries are dropped."""
    queries = _flat(_flat(shards.getField("searches")).getField("query"))
    return F.filter(F.flatten(F.transform(queries, lambda q: F.map_entries(q["breakdown"]))), lambda e: ~e["key"].endswith("_count"))


def _top_phases(entries: Column, k: int) -> Column:
    """The ``k`` phases with the largest sums; ties keep the order in which
    phases first appear.  ``entries`` must be a column that is already made."""

    def one(name: Column, i: Column) -> Column:
        total = F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: F.when(e["key"] == name, acc + F.coalesce(e["value"], F.lit(0)).cast("bigint")).otherwise(acc))
        return F.struct((-nanos_to_ms(total)).alias("order"), i.alias("i"), name.alias("phase"), nanos_to_ms(total).alias("time_ms"))

    ranked = F.slice(F.array_sort(F.transform(F.array_distinct(entries.getField("key")), one)), 1, k)
    return F.transform(ranked, lambda x, r: F.struct((r + 1).alias("rank"), x["phase"].alias("phase"), x["time_ms"].alias("time_ms")))


def _shards_of(profile_col: str) -> Column:
    return F.coalesce(F.col(f"{profile_col}.shards"), F.array())


def slowest_shard(profiles: DataFrame, id_col: str = "run_id", profile_col: str = "profile") -> DataFrame:
    """The shard with the largest query+fetch+aggregation time; first wins ties
    (A30).  Within the row, no shuffle; profiles that share an id stay apart."""
    some = profiles.where(F.size(_shards_of(profile_col)) > 0)
    per = _staged(some, [id_col], __per=_per_shard(_shards_of(profile_col)))
    best = _staged(per, [id_col], __best=F.get("__per", _slowest_place(F.col("__per"))))
    return best.select(F.col(id_col), F.inline(F.array(_slowest_record(F.col("__best")))))


def top_query_components(profiles: DataFrame, id_col: str = "run_id", profile_col: str = "profile", k: int = 3) -> DataFrame:
    """Top ``k`` query components by time per profile, with rank (O6), in the row."""
    return profiles.select(F.col(id_col), F.inline(_top_listed(_shards_of(profile_col), "query", ("type", "description"), k)))


def top_collectors(profiles: DataFrame, id_col: str = "run_id", profile_col: str = "profile", k: int = 3) -> DataFrame:
    """Top ``k`` collectors by time per profile, with rank (O6), in the row."""
    return profiles.select(F.col(id_col), F.inline(_top_listed(_shards_of(profile_col), "collector", ("name", "reason"), k)))


def top_breakdown_phases(profiles: DataFrame, id_col: str = "run_id", profile_col: str = "profile", k: int = 3) -> DataFrame:
    """Breakdown totals per phase, top ``k`` per profile (A29, O6), in the row."""
    entries = _staged(profiles, [id_col], __entries=_phase_entries(_shards_of(profile_col)))
    return entries.select(F.col(id_col), F.inline(_top_phases(F.col("__entries"), k)))


# Run columns a profile record carries, in order.
RECORD_COLUMNS = ("name", "path", "method", "iteration", "query_type")


def profile_records(runs: DataFrame, profile_col: str = "profile") -> DataFrame:
    """Profile result record per run (P12): the run's name, path, method,
    round and side, ``duration_ms`` / ``took_ms``, and ``profile_summary``: the
    roll-up totals, the slowest shard and the three top lists.  Runs without shards get no
    record.  Computed inside the row, no shuffle."""
    shards = _shards_of(profile_col)
    cols = [F.col(c) if c in runs.columns else F.lit(None).alias(c) for c in RECORD_COLUMNS]
    run = [*RECORD_COLUMNS, "duration_ms", "took_ms"]
    some = runs.where(F.size(shards) > 0).select(*cols, F.col("duration").alias("duration_ms"), F.col("took").alias("took_ms"), F.col(profile_col).alias("__profile"))
    inner = _shards_of("__profile")
    parts = _staged(
        some,
        run,
        __per=_per_shard(inner),
        __components=_top_listed(inner, "query", ("type", "description"), 3),
        __collectors=_top_listed(inner, "collector", ("name", "reason"), 3),
        __entries=_phase_entries(inner),
    )
    per = F.col("__per")
    summary = F.struct(
        F.size(per).alias("shard_count"),
        nanos_to_ms(_total(per.getField("q"))).alias("total_query_time_ms"),
        nanos_to_ms(_total(per.getField("f"))).alias("total_fetch_time_ms"),
        nanos_to_ms(_total(per.getField("a"))).alias("total_aggregation_time_ms"),
        nanos_to_ms(_total(per.getField("r"))).alias("total_rewrite_time_ms"),
        _slowest_record(F.get(per, F.col("__slowest"))).alias("slowest_shard"),
        F.col("__components").alias("top_query_components"),
        F.col("__collectors").alias("top_collectors"),
        _top_phases(F.col("__entries"), 3).alias("top_breakdown"),
    )
    placed = _staged(parts, [*run, "__per", "__components", "__collectors", "__entries"], __slowest=_slowest_place(per))
    return _staged(placed, run, profile_summary=summary)
