"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import centroid_clusters, decontaminate, disclosure, language_hd, neardup, periodic_runs, quality_gbt, secrets, sentencepiece_codec, substring_dedup, topk_covertree, toxicity_fm, warc
from fleetlens.llm.common import is_remainder, table
from fleetlens.llm.spans import listed as span_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

QUALITY_THRESHOLD = 0.3
TOXIC_THRESHOLD = 0.7


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_model(name: str = "piece_bpe_32k.model") -> bytes:
    """The tokenizer file's content, read once on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@register
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated windows."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every 50th vector among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_covertree.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


@register
def op3_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learns outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~is_remainder("doc_id", 5, 0))
    scored = quality_gbt.score(docs, quality_gbt.fit(docs, labels))
    return scored.select(
        "doc_id",
        is_remainder("doc_id", 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


@register
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item that overlap."""
    return decontaminate.found_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


@register
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    read = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with their status in the corpus."""
    rows, found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] != "owned")
    return secrets.with_spans(rows, found).select(
        F.col("id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["status"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: s["status"] == "example")).cast("long").alias("n_example"),
    )


@register
def op8_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learns outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~is_remainder("doc_id", 3, 1))
    scored = toxicity_fm.score(docs, toxicity_fm.fit(docs, labels))
    return scored.select(
        "doc_id",
        is_remainder("doc_id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"),
    )


@register
def op9_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learns outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_hd.fit(docs.where(~is_remainder("doc_id", 3, 1)))
    found = language_hd.predict(docs, model)
    return found.select("doc_id", is_remainder("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@register
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    coded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_model())
    return coded.select("doc_id", *code_digests())


@register
def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that give it away."""
    rows, _ = disclosure.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["ord"] < 4)
    return rows.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in disclosure.KINDS],
        F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
    )


@register
def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds over 16 centroids."""
    assigned, centroids = centroid_clusters.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dim=64, scale=64)
    found = centroid_clusters.with_inertia(assigned, centroids)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document and its text without repeated periods."""
    found = periodic_runs.find_runs(periodic_runs.refolded(table(spark, sf_dir, "documents").select("doc_id", "text")))
    runs = F.col("runs")
    # longest first, then the smallest start and period
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    found = found.withColumn("best", best)
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(-1000 * F.col("best.l") / F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


def code_digests() -> list[Column]:
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]
