"""Fleet inventory: active clusters, cluster report, summary, name lookup
(A19-A21, J1, J4, W6, O8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.scalars import format_bytes, format_duration, used_percent
from fleetlens.operators.filters import system_cluster
from fleetlens.operators.joins import lookup_join
from fleetlens.session import write_shared


def active_clusters(metrics: DataFrame, cluster_col: str = "cluster_id", name_col: str = "cluster_name", top: int | None = None) -> DataFrame:
    """Clusters seen in the metrics by document count (A19, W6, O8); ``top``
    keeps that many of the largest, by default all are kept.

    The name is the most frequent non-null name of the cluster (ties: the one
    that sorts first), falling back to the id.  One pass: counts per (cluster,
    name) are summed before the shuffle, so a cluster holding a third of the
    rows is no hot task, and a second aggregate over that small table gives the
    total and the name.
    """
    per_name = metrics.groupBy(F.col(cluster_col).alias("cluster_id"), F.col(name_col).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("name").isNotNull(), F.struct((-F.col("n")).alias("order"), "name")))
    out = per_name.groupBy("cluster_id").agg(F.sum("n").alias("n"), best.alias("best")).select(
        F.col("cluster_id").cast("string").alias("cluster_id"),
        F.coalesce("best.name", F.col("cluster_id").cast("string")).alias("cluster_name"),
        F.col("n").cast("bigint").alias("doc_count"),
    )
    return out if top is None else out.orderBy(F.col("doc_count").desc(), F.col("cluster_id").asc()).limit(top)


def _falsy_fallback(primary: Column, *fallbacks: Column) -> Column:
    """First value that is neither null nor 0 nor empty text, else 0."""
    return F.coalesce(F.nullif(primary, F.lit(0)), *[F.nullif(f, F.lit(0)) for f in fallbacks], F.lit(0))


def fleet_report(
    registry: DataFrame,
    status: DataFrame,
    summary: DataFrame,
    include_system: bool = False,
    system_ids: list[str] | None = None,
    system_name_words: list[str] | None = None,
) -> DataFrame:
    """One ClusterInfo row per registered cluster.

    ``registry ⟕ status ⟕ summary`` on the cluster id.  Registry, status and
    summary hold one row per cluster; adaptive execution broadcasts a side
    only once its measured size is under the broadcast threshold.  Values
    fall through from the metric summary to the status health block when the
    summary value is null, 0 or empty, as the console does.
    """
    reg = registry
    if not include_system:
        reg = reg.where(~system_cluster(F.col("id"), F.col("name"), system_ids or [], system_name_words or []))
    st = status.select(
        F.col("cluster_id").alias("st_id"),
        F.col("available").alias("st_available"),
        F.col("health.status").alias("h_status"),
        F.col("health.number_of_nodes").alias("h_nodes"),
        F.col("health.active_primary_shards").alias("h_primary"),
        F.col("health.active_shards").alias("h_shards"),
        F.col("health.unassigned_shards").alias("h_unassigned"),
    )
    sm = summary.withColumnRenamed("cluster_id", "sm_id")
    j = reg.join(st, reg.id == st.st_id, "left").join(sm, reg.id == sm.sm_id, "left")

    used_store = F.coalesce(F.col("used_store_bytes"), F.lit(0)).cast("bigint")
    max_store = F.coalesce(F.col("max_store_bytes"), F.lit(0)).cast("bigint")
    used_jvm = F.coalesce(F.col("used_jvm_bytes"), F.lit(0)).cast("bigint")
    max_jvm = F.coalesce(F.col("max_jvm_bytes"), F.lit(0)).cast("bigint")
    # first element of the summary's version list, else the registry's version
    summary_version = F.get(sm["version"], 0)
    return j.select(
        F.col("id").alias("cluster_id"),
        F.col("name").alias("display_name"),
        F.coalesce(F.nullif(F.col("cluster_name"), F.lit("")), F.col("name")).alias("cluster_name"),
        F.coalesce(F.nullif(summary_version, F.lit("")), reg["version"]).alias("version"),
        F.coalesce(F.nullif(F.col("status"), F.lit("")), F.col("h_status"), F.lit("unknown")).alias("health_status"),
        F.coalesce(F.col("st_available"), F.lit(False)).alias("available"),
        F.coalesce(F.col("monitored"), F.lit(False)).alias("monitored"),
        F.when(F.coalesce(F.col("uptime"), F.lit(0)) != 0, format_duration(F.col("uptime"))).otherwise(F.lit("Unknown")).alias("uptime"),
        _falsy_fallback(F.col("nodes_count"), F.col("h_nodes")).cast("bigint").alias("nodes_count"),
        F.coalesce(F.col("indices_count"), F.lit(0)).cast("bigint").alias("indices_count"),
        _falsy_fallback(F.col("primary_shards"), F.col("h_primary")).cast("bigint").alias("primary_shards"),
        _falsy_fallback(F.col("total_shards"), F.col("h_shards")).cast("bigint").alias("total_shards"),
        _falsy_fallback(F.col("unassigned_shards"), F.col("h_unassigned")).cast("bigint").alias("unassigned_shards"),
        F.coalesce(F.col("document_count"), F.lit(0)).cast("bigint").alias("documents_count"),
        used_store.alias("storage_used_bytes"),
        max_store.alias("storage_total_bytes"),
        format_bytes(used_store).alias("storage_used_formatted"),
        format_bytes(max_store).alias("storage_total_formatted"),
        used_jvm.alias("jvm_used_bytes"),
        max_jvm.alias("jvm_total_bytes"),
        format_bytes(used_jvm).alias("jvm_used_formatted"),
        format_bytes(max_jvm).alias("jvm_total_formatted"),
        used_percent(used_jvm, max_jvm).alias("jvm_used_percent"),
    )


def fleet_summary(report: DataFrame) -> DataFrame:
    """Totals over the report in one global aggregate."""
    storage = F.coalesce(F.sum("storage_used_bytes"), F.lit(0)).cast("bigint")
    return report.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.count_if(F.col("available")).alias("available_clusters"),
        F.count_if(F.col("monitored")).alias("monitored_clusters"),
        F.coalesce(F.sum("nodes_count"), F.lit(0)).cast("bigint").alias("total_nodes"),
        F.coalesce(F.sum("indices_count"), F.lit(0)).cast("bigint").alias("total_indices"),
        F.coalesce(F.sum("documents_count"), F.lit(0)).cast("bigint").alias("total_documents"),
        storage.alias("total_storage_used"),
    ).withColumn("total_storage_used_formatted", format_bytes(F.col("total_storage_used")))


def health_distribution(report: DataFrame) -> DataFrame:
    """Clusters per health status."""
    return report.groupBy("health_status").agg(F.count(F.lit(1)).alias("clusters"))


# Match kinds in the order they are tried.
MATCH_EXACT, MATCH_CASE_INSENSITIVE, MATCH_SUBSTRING = "exact", "case_insensitive", "substring"


def _grams(text: Column, length: int) -> Column:
    """Distinct pieces of exactly ``length`` characters; none in a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - length + 1)
    return F.when(F.length(text) >= length, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, length)))).otherwise(F.array().cast("array<string>"))


#: Registry names that share a piece and meet its requests in one task.
NAMES_PER_TASK = 20_000


def _containing(requests: DataFrame, registry: DataFrame, gram: int) -> DataFrame:
    """(request, cid) of every registry name (cid, low) that contains the
    lower-cased request: an inverted index of the names' pieces.

    Each request goes to the rarest of its pieces alone (itself, if shorter
    than a piece), and to none if one of its pieces stands in no name;
    ``contains`` confirms.  A piece of very many names is split over as many
    parts as its names need.
    """
    names = F.concat(*[_grams(F.col("low"), n) for n in range(1, gram + 1)])
    pieces = registry.select("cid", F.col("low").alias("rlow"), F.explode(names).alias("piece"))
    known = write_shared(pieces.groupBy("piece").agg(F.count("*").alias("names")), "name-pieces")
    low = F.lower("request")
    own = F.when(F.length(low) < gram, F.array(low)).otherwise(_grams(low, gram))
    asked = requests.select("request", F.explode(own).alias("piece")).join(known, "piece", "left")
    rarest = asked.groupBy("request").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "piece")).alias("r"))
    parts = F.ceil(F.col("names") / NAMES_PER_TASK).cast("int")
    chosen = write_shared(rarest.where("r.names > 0").select("request", "r.*").withColumn("parts", parts), "name-requests")
    held = lookup_join(pieces, chosen.select("piece", "parts").distinct(), "piece", "inner")
    held = held.withColumn("part", F.pmod(F.xxhash64("cid", "rlow"), F.col("parts")).cast("int")).drop("parts")
    meets = chosen.select("request", "piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return meets.join(held, ["piece", "part"]).where(F.contains("rlow", low)).select("request", "cid")


def resolve_cluster_names(requests: DataFrame, registry: DataFrame, name_col: str = "name", allow_substring: bool = True, gram: int = 3) -> DataFrame:
    """Cluster name -> id: exact, then case-insensitive, then unique substring.

    One join on the lower-cased name settles the first two kinds (equality
    gives the rank).  Only requests it leaves open go on to the index of the
    names' pieces (:func:`_containing`).  Per request the best kind wins;
    several ids of that kind are ``ambiguous``, none is ``not_found``.
    """
    req = requests.select(F.trim(F.col(name_col)).alias("request")).where(F.col("request") != "").distinct()
    reg = registry.select(F.col("id").alias("cid"), F.trim(F.col("name")).alias("cname")).where("cid is not null and cname is not null and cname <> ''")
    reg = reg.withColumn("low", F.lower("cname"))
    by_name = req.withColumn("low", F.lower("request")).join(reg, "low", "left")
    kind = F.when(F.col("cid").isNotNull(), F.when(F.col("request") == F.col("cname"), 1).otherwise(2))
    per_kind = by_name.groupBy("request", kind.alias("kind")).agg(F.countDistinct("cid").alias("candidates"), F.min("cid").alias("cid"))
    best = per_kind.groupBy("request").agg(F.min_by(F.struct("kind", "candidates", "cid"), F.coalesce("kind", F.lit(9))).alias("b")).select("request", "b.*")
    if allow_substring:
        best = write_shared(best, "name-matches")
        inside = _containing(best.where("kind is null").select("request"), reg, gram)
        found = inside.groupBy("request").agg(F.lit(3).alias("kind"), F.countDistinct("cid").alias("candidates"), F.min("cid").alias("cid"))
        found = found.select("request", F.struct("kind", "candidates", "cid").alias("sub"))
        best = best.join(found, "request", "left").select(
            "request", *[F.when(F.col("kind").isNull() & F.col("sub").isNotNull(), F.col(f"sub.{c}")).otherwise(F.col(c)).alias(c) for c in ("kind", "candidates", "cid")]
        )
    names = F.when(F.col("kind") == 1, MATCH_EXACT).when(F.col("kind") == 2, MATCH_CASE_INSENSITIVE).when(F.col("kind") == 3, MATCH_SUBSTRING)
    return best.select(
        F.col("request").alias("name"),
        F.when(F.col("candidates") == 1, F.col("cid")).alias("cluster_id"),
        names.alias("match_type"),
        F.coalesce(F.col("candidates"), F.lit(0)).cast("bigint").alias("candidates"),
        F.when(F.col("kind").isNull(), "not_found").when(F.col("candidates") > 1, "ambiguous").otherwise("ok").alias("status"),
    )


def latest_cluster_status(cluster_health: DataFrame, start_end: tuple | None = None, ts_col: str = "timestamp") -> DataFrame:
    """Newest health document per cluster, optionally within a time window.

    ``row_number() = 1`` per cluster ordered by (time desc, ``_id`` desc),
    planned with a partial ``WindowGroupLimit`` before the exchange.
    """
    from fleetlens.operators.filters import time_window

    df = cluster_health if start_end is None else time_window(cluster_health, ts_col, start_end[0], start_end[1])
    w = Window.partitionBy("cluster_id").orderBy(F.col(ts_col).desc(), F.col("_id").desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")
