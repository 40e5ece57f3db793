"""Alert tables: time filter on the type's own column, ordering, rule join
(F4, O2, J10, S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.filters import time_window
from fleetlens.sources.tables import ALERT_TIME_COLUMNS


def filter_alerts(df: DataFrame, alert_type: str, start=None, end=None, hours: int = 1) -> DataFrame:
    """Time filter on ``created`` / ``timestamp``; rules are not time-filtered."""
    col = ALERT_TIME_COLUMNS[alert_type]
    if col is None:
        return df
    return time_window(df, col, start, end, hours)


def sort_alerts(df: DataFrame, alert_type: str, id_col: str = "_id") -> DataFrame:
    """Newest first by the type's time column, ``_id`` ascending; a missing
    time column is tolerated (O2).  A global sort: range-partitioned, so it
    scales, but only asked for when order matters."""
    col = ALERT_TIME_COLUMNS.get(alert_type)
    keys = []
    if col and col in df.columns:
        keys.append(F.col(col).desc_nulls_last())
    if id_col in df.columns:
        keys.append(F.col(id_col).asc())
    return df.orderBy(*keys) if keys else df


def messages_with_rules(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Alert message -> its rule (``rule_id`` = rule ``id``), left join.

    No broadcast hint: the rule table is configuration and usually small, and
    adaptive execution broadcasts it once its measured size allows.
    """
    r = rules.select(
        F.col("id").alias("rule_id"),
        F.col("name").alias("rule_name"),
        F.col("enabled").alias("rule_enabled"),
        F.col("resource_type").alias("rule_resource_type"),
    )
    return messages.join(r, "rule_id", "left")
