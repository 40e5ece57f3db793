"""Sinks (K1-K13): JSON Lines, capped files, split output, CSV reports, and
read-back of per-file counts.  All are ``DataFrameWriter`` calls: one task per
output partition writes its own files, nothing is gathered on the driver.
``planned_files`` deals rows out before a split write, so that every value gets
full files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.nested import quote_path

# Rows per output file unless asked otherwise (K2).
DEFAULT_ROWS_PER_FILE = 100_000


#: Parts of a split value in which rows are numbered independently.
NUMBERED_PARTS = 4096


def write_json_lines(
    df: DataFrame,
    path: str,
    rows_per_file: int | None = DEFAULT_ROWS_PER_FILE,
    split_by: list[str] | None = None,
    compression: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Compact JSON Lines, nulls kept (K1), at most ``rows_per_file`` rows per
    file (K2), optionally one folder per split column value (K7) and
    compressed.  An empty result still writes a (empty) part file (K3).
    """
    _writer(df, rows_per_file, split_by, compression, mode).option("ignoreNullFields", "false").json(path)


def write_text_lines(
    df: DataFrame,
    path: str,
    rows_per_file: int | None = DEFAULT_ROWS_PER_FILE,
    split_by: list[str] | None = None,
    compression: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Lines that are JSON text already (column ``value``), laid out likewise."""
    _writer(df, rows_per_file, split_by, compression, mode).text(path)


def _writer(df: DataFrame, rows_per_file: int | None, split_by: list[str] | None, compression: str | None, mode: str) -> DataFrameWriter:
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", int(rows_per_file))
    if compression:
        writer = writer.option("compression", compression)
    return writer.partitionBy(*split_by) if split_by else writer


def planned_files(df: DataFrame, split_by: list[str], rows_per_file: int, id_cols: list[str]) -> DataFrame:
    """``df`` dealt out so that a split write gives each value
    ``ceil(rows / rows_per_file)`` files (K2, K7).

    Rows of a value are numbered and file i gets the i-th ``rows_per_file`` of
    them.  Numbers come in two levels: rows are counted per value and part (a
    hash of ``id_cols``), the counts are summed over the parts, and inside a
    part rows follow their hash.  So a value with a third of all rows is
    numbered by thousands of tasks and written by as many as it has files.
    The counting pass reads the split and id columns alone.
    """
    own = [c for c in df.columns if c not in split_by]
    h = F.xxhash64(*[F.col(quote_path(c)) for c in id_cols])
    marked = df.withColumns({"__h": h, "__part": F.pmod(h, F.lit(NUMBERED_PARTS))})
    keys = [*split_by, "__part"]
    counts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*split_by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)]
    # rows with one id are told apart by their content, so a repeated task numbers them alike
    order = Window.partitionBy(*keys).orderBy("__h", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]))))
    numbered = marked.join(offsets, same).withColumn("__row", F.col("__before") + F.row_number().over(order) - 1)
    return numbered.withColumn("__file", F.floor(F.col("__row") / rows_per_file)).repartition(*split_by, "__file").select(*df.columns)


def file_row_counts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Rows per written file, read back (K4).  JSON Lines are counted as lines,
    not parsed."""
    df = spark.read.format("text" if fmt == "json" else fmt).load(path)
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def write_csv_report(df: DataFrame, path: str, yes_no: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with a header (K8, K9, K12); listed boolean columns rendered yes/no."""
    out = df
    for c in yes_no or []:
        out = out.withColumn(c, F.when(F.col(c), F.lit("yes")).otherwise(F.lit("no")))
    out.write.mode(mode).option("header", True).csv(path)


def write_cluster_samples_json(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sampling report by cluster (K10): one folder per cluster, one line per
    index in it.  No cluster's indices are gathered into one row."""
    samples.write.mode(mode).partitionBy("cluster_id", "cluster_name").option("ignoreNullFields", "false").json(path)


def write_report(record: DataFrame, results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report record and its results (K13): ``path/report`` and ``path/results``."""
    write_json_lines(record, f"{path}/report", mode=mode)
    write_json_lines(results, f"{path}/results", mode=mode)


def write_index_details(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per (cluster, index) with its details."""
    samples.write.mode(mode).partitionBy("cluster_id", "index_name").option("ignoreNullFields", "false").json(path)
