"""Default classification and declared schemas."""

import pytest
from pyspark.sql import types as T

from fleetlens.functions import fieldspec
from fleetlens.functions.nested import field_type

# Entries per type (rate, latency, max).
COUNTS = {"node_stats": (53, 5, 67), "index_stats": (26, 4, 12), "cluster_health": (0, 0, 12), "cluster_stats": (0, 0, 60), "shard_stats": (6, 2, 2)}


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_entries_and_schema(name):
    rules = fieldspec.default_rules(name)
    assert (len(rules.rate), len(rules.latency), len(rules.max)) == COUNTS[name]
    assert len({*rules.rate, *rules.max, *rules.latency}) == sum(COUNTS[name])
    schema = fieldspec.document_schema(name)
    assert fieldspec.classify_fields(schema, name) == rules
    for group in fieldspec.METRIC_TYPES[name].group_fields:
        assert isinstance(field_type(schema, group), T.StringType)
    assert fieldspec.classify_fields(T.StructType([]), name) == fieldspec.FieldRules()


def test_gauges_are_not_rates():
    rules = fieldspec.default_rules("cluster_stats")
    root = fieldspec.payload_root("cluster_stats")
    assert f"{root}.nodes.count.total" in rules.max and not rules.rate


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_sampled_job_per_type(spark, tmp_dir, name):
    """JSON in, default rules, every classified field handled by its kind."""
    import json

    from fleetlens.plans.job import ExportJob, run_export_job

    rules = fieldspec.default_rules(name)
    inputs = [*rules.inputs(), *rules.max]
    docs = []
    for k in range(3):  # two documents in the first hour, one in the second
        doc = {"_id": str(k), "timestamp": f"2024-01-01T0{k // 2}:{10 + k}:00Z", "metadata": {"name": name, "labels": dict.fromkeys(fieldspec.LABEL_FIELDS, "x")}}
        for p in inputs:
            *parents, leaf = p.split(".")
            node = doc
            for part in parents:
                node = node.setdefault(part, {})
            node[leaf] = (5 - k) if p in rules.max and p not in rules.rate else 100 * (k + 1)
        docs.append(json.dumps(doc))
    spark.createDataFrame([(d,) for d in docs], "value string").write.text(f"{tmp_dir}/in")
    job = ExportJob(name="j", output_path=f"{tmp_dir}/out", metrics_path=f"{tmp_dir}/in", metrics_format="json", metric_types=[name], start="2024-01-01", end="2024-01-01", sampling_interval="1h", include_clusters=["x"])
    (summary,) = run_export_job(spark, job).collect()
    assert summary.error is None and summary.rows == 2
    first, second = sorted((json.loads(r.value) for r in spark.read.text(f"{tmp_dir}/out/{name}").collect()), key=lambda d: d["timestamp"])

    def at(doc, path):
        for part in path.split("."):
            doc = doc[part]
        return doc

    for p in rules.rate:
        assert (at(first, p), at(second, p)) == (200.0, pytest.approx(100 / 3600))
    for p in rules.latency:
        assert at(second, p) == 1.0
    for p in set(rules.max) - set(rules.rate):
        assert (at(first, p), at(second, p)) == (5.0, 3.0)
