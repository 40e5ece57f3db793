"""Metric types: series keys, classified fields and payload schemas.

Which numeric field is a cumulative counter, a gauge or an average latency is
data: the fixed table in ``fieldtable``.  It can be replaced per type by an
explicit ``FieldRules``.  The declared schema of a type holds its classified
fields, their inputs and the envelope, so JSON is read without inference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from fleetlens.functions import fieldtable as table
from fleetlens.functions.nested import field_type
from fleetlens.operators.sampling import FieldRules


@dataclass(frozen=True)
class MetricType:
    name: str
    group_fields: tuple[str, ...]
    fixed_groups: bool


# The five metric types, their series keys, and whether the key
# is fixed (node and index stats) or probed from the data.
LABELS = "metadata.labels"
METRIC_TYPES = {
    "cluster_health": MetricType("cluster_health", (f"{LABELS}.cluster_id", f"{LABELS}.cluster_name"), False),
    "cluster_stats": MetricType("cluster_stats", (f"{LABELS}.cluster_id", f"{LABELS}.cluster_name"), False),
    "node_stats": MetricType("node_stats", (f"{LABELS}.cluster_id", f"{LABELS}.node_id"), True),
    "index_stats": MetricType("index_stats", (f"{LABELS}.cluster_id", f"{LABELS}.index_name"), True),
    "shard_stats": MetricType("shard_stats", (f"{LABELS}.cluster_id", f"{LABELS}.index_name", f"{LABELS}.shard_id"), False),
}

# Envelope fields that every document may carry, all text.
LABEL_FIELDS = "cluster_id cluster_name cluster_uuid node_id node_name transport_address ip index_id index_name index_uuid shard_id".split()
AGENT_FIELDS = "id name version".split()

_BY_TYPE: dict[str, tuple[list[str], dict[str, tuple[str, str]], list[str]]] = {
    "node_stats": (table.NODE_RATE, table.NODE_LATENCY, table.NODE_MAX),
    "index_stats": (table.INDEX_RATE, table.INDEX_LATENCY, table.INDEX_MAX),
    "cluster_health": ([], {}, table.HEALTH_MAX),
    "cluster_stats": ([], {}, table.CLUSTER_MAX),
    "shard_stats": (table.SHARD_RATE, table.SHARD_LATENCY, table.SHARD_MAX),
}


def payload_root(metric_type: str) -> str:
    return f"payload.elasticsearch.{metric_type}"


def default_rules(metric_type: str) -> FieldRules:
    """All classified fields of a type, with full paths."""
    root = payload_root(metric_type)
    rate, latency, peak = _BY_TYPE[metric_type]
    return FieldRules(
        rate=tuple(f"{root}.{p}" for p in rate),
        latency={f"{root}.{out}": (f"{root}.{t}", f"{root}.{n}") for out, (t, n) in latency.items()},
        max=tuple(f"{root}.{p}" for p in peak),
    )


def classify_fields(schema: T.StructType, metric_type: str) -> FieldRules:
    """The default rules cut to what ``schema`` holds: a rate or maximum needs
    its field, a latency both inputs."""
    rules = default_rules(metric_type)

    def there(path: str) -> bool:
        return field_type(schema, path) is not None

    return FieldRules(
        rate=tuple(p for p in rules.rate if there(p)),
        latency={out: pair for out, pair in rules.latency.items() if all(map(there, pair))},
        max=tuple(p for p in rules.max if there(p)),
    )


def _struct(tree: dict) -> T.StructType:
    return T.StructType([T.StructField(name, _struct(sub) if isinstance(sub, dict) else sub) for name, sub in tree.items()])


def _envelope() -> dict:
    return {
        "_id": T.StringType(),
        "timestamp": T.TimestampType(),
        "agent": dict.fromkeys(AGENT_FIELDS, T.StringType()),
        "metadata": {
            "name": T.StringType(),
            "category": T.StringType(),
            "datatype": T.StringType(),
            "labels": dict.fromkeys(LABEL_FIELDS, T.StringType()),
        },
    }


def envelope_schema() -> T.StructType:
    """Id, time, agent and metadata, which all types share."""
    return _struct(_envelope())


def document_schema(metric_type: str) -> T.StructType:
    """Declared schema of a type's documents: the envelope and the payload.

    Averages, percentages and load are doubles, other numbers longs."""
    rules, tree = default_rules(metric_type), _envelope()
    paths = [*rules.rate, *(p for pair in rules.latency.values() for p in pair), *rules.max]
    if metric_type == "cluster_health":
        paths.append(f"{payload_root(metric_type)}.status")
    for path in paths:
        *parents, leaf = path.split(".")
        node = tree
        for name in parents:
            node = node.setdefault(name, {})
        if leaf == "status":
            node[leaf] = T.StringType()
        else:
            fraction = leaf == "avg" or "percent" in leaf or "load_average" in parents
            node[leaf] = T.DoubleType() if fraction else T.LongType()
    return _struct(tree)
