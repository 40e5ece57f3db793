"""Catalog sampling: N documents and the schema facts per index (J2, J3, O3,
O4, W3, W4, F10-F12, P13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.filters import drop_unavailable_indices, exclude_system_indices


def eligible_indices(
    registry: DataFrame,
    status: DataFrame,
    catalog: DataFrame,
    max_indices: int = 0,
    include_system: bool = False,
) -> DataFrame:
    """Indices to sample, one row per (cluster, index).

    Only clusters with a status row that says available (inner join); system
    and unavailable indices are skipped before the per-cluster cap, so skipped
    ones do not count against it.  ``max_indices = 0`` means no cap.  The cap
    keeps the first indices in name order (a total order, unlike the
    response order the console happens to return).
    """
    up = status.where(F.col("available")).select(F.col("cluster_id").alias("sid"))
    reg = registry.join(up, registry.id == up.sid, "inner").select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name"))
    idx = exclude_system_indices(catalog, "index", include_system)
    idx = drop_unavailable_indices(idx, "health")
    j = idx.join(reg, "cluster_id", "inner")
    j = j.select(
        "cluster_id",
        "cluster_name",
        F.col("index").alias("index_name"),
        F.col("health"),
        F.coalesce(F.expr("try_cast(trim(docs_count) AS BIGINT)"), F.lit(0)).cast("bigint").alias("doc_count"),
    )
    if max_indices > 0:
        w = Window.partitionBy("cluster_id").orderBy("index_name")
        j = j.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max_indices).drop("__rn")
    return j


def sample_documents(indices: DataFrame, documents: DataFrame, sample_size: int = 2, order_col: str = "seq") -> DataFrame:
    """First ``sample_size`` documents of every eligible index, long form.

    ``row_number() <= n`` is planned with a partial ``WindowGroupLimit``
    before the exchange, so even an index holding a third of all documents
    ships only ``n`` rows per input partition.  Documents are joined to the
    (small) eligible index list with a semi join first.
    """
    keys = indices.select("cluster_id", "index_name")
    docs = documents.withColumnRenamed("index", "index_name").join(keys, ["cluster_id", "index_name"], "left_semi")
    w = Window.partitionBy("cluster_id", "index_name").orderBy(F.col(order_col).asc(), F.col("_id").asc())
    return (
        docs.withColumn("doc_rank", F.row_number().over(w))
        .where(F.col("doc_rank") <= sample_size)
        .select("cluster_id", "index_name", "doc_rank", "_id", "_source")
    )


def index_samples(indices: DataFrame, samples: DataFrame) -> DataFrame:
    """Nested report row per index: facts plus the array of sampled documents
    (K9/K10 shape), ``index ⟕ samples``; each array holds at most n entries."""
    nested = samples.groupBy("cluster_id", "index_name").agg(
        F.array_sort(F.collect_list(F.struct("doc_rank", "_id", "_source"))).alias("sample_docs")
    )
    j = indices.join(nested, ["cluster_id", "index_name"], "left")
    return j.select(
        "cluster_id",
        "cluster_name",
        "index_name",
        "doc_count",
        F.coalesce(F.col("sample_docs"), F.array().cast("array<struct<doc_rank:int,_id:string,_source:string>>")).alias("sample_docs"),
    )


def _index_entry(body: Column, index_col: str) -> Column:
    """``body[<index>]`` of a response keyed by index name, as VARIANT."""
    return F.element_at(F.try_variant_get(body, "$", "map<string,variant>"), F.col(index_col))


def unwrap_mapping(df: DataFrame, json_col: str = "mapping_json", index_col: str = "index_name") -> Column:
    """Mapping response -> the index's ``mappings`` object; the whole body when
    the index is not a key of it (S9)."""
    body = F.try_parse_json(F.col(json_col))
    entry = _index_entry(body, index_col)
    return F.coalesce(F.try_variant_get(entry, "$.mappings", "variant"), entry, body)


def unwrap_settings(df: DataFrame, json_col: str = "settings_json", index_col: str = "index_name") -> Column:
    """Settings response -> ``settings.index`` (or ``settings``) of the index,
    ready for ``flatten_variant(…, prefix="index")``; the whole body when the
    index is not a key of it (S9)."""
    body = F.try_parse_json(F.col(json_col))
    settings = F.try_variant_get(_index_entry(body, index_col), "$.settings", "variant")
    index_part = F.try_variant_get(settings, "$.index", "variant")
    is_obj = F.try_variant_get(index_part, "$", "map<string,variant>").isNotNull()
    return F.coalesce(F.when(is_obj, index_part), settings, body)


def with_mappings(indices: DataFrame, mappings: DataFrame) -> DataFrame:
    """Eligible index ⟕ its mapping (J3): ``mapping`` as compact JSON text and
    a ``has_mapping`` flag.  ``mappings`` has ``cluster_id, index_name,
    mapping_json``; one row per index, joined on (cluster, index)."""
    m = mappings.select("cluster_id", "index_name", F.to_json(unwrap_mapping(mappings)).alias("mapping"))
    j = indices.join(m, ["cluster_id", "index_name"], "left")
    return j.withColumn("has_mapping", F.col("mapping").isNotNull())
