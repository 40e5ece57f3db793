"""The corpus pipeline: stages over ``documents``, each by one llm operator.

Every stage works on all rows its predecessor kept.  All but the last return
the columns of ``documents``; the last returns one row of digests per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, neardup, quality_gbt, queries, secrets, sentencepiece_codec
from fleetlens.llm.common import table
from fleetlens.session import fresh_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    model = quality_gbt.fit(docs, table(spark, sf_dir, "labels"))
    return quality_gbt.keep(docs, model, queries.QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id."""
    return neardup.one_of_each(docs, neardup.near_duplicates(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.clean(docs, decontaminate.found_items(docs, table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; ``n_chars`` follows."""
    _, found = secrets.find_secrets(docs)
    return secrets.redact(docs, found).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of what is left, as digests."""
    coded = sentencepiece_codec.encode(docs, queries.tokenizer_model())
    return coded.select("doc_id", *queries.code_digests())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", mask_secrets),
    ("encode", encode),
]

#: Trained trees and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
