"""Session construction and lineage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every fleetlens job relies on.  Adaptive execution re-plans joins
# (broadcast only when the measured side is under the threshold), coalesces
# small shuffle partitions and splits skewed ones at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "fleetlens",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Get or create a session with the fleetlens defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at storage that the driver and every
    executor share; without it this raises.  Only a local session (tests) gets
    a private folder, which it then keeps as its setting.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="fleetlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses (not created)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fleetlens-{label}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    The files are committed by Spark's writer, so lost executors, retried and
    speculative tasks leave no partial rows, and later stages reread them.
    """
    path = fresh_folder(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialized(df: DataFrame) -> DataFrame:
    """Evaluate ``df``'s columns once, in generated code.

    ``inline(array(struct(*)))`` is a generator: the optimizer does not merge
    the expressions of its columns into later projections and filters, in
    particular not into ones that higher-order functions force out of generated
    code.  Columns read from storage need no such step.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df``, a table that was written, is read from."""
    files = df.inputFiles()
    if not files:
        return 0
    return int(df.sparkSession.read.format("binaryFile").load(files).agg({"length": "sum"}).first()[0] or 0)
