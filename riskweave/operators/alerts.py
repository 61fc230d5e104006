"""Alerts: trigger, store, overlay of status changes, and read queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

# States of an alert, and those that count as raised.
STATUSES = ("Open", "Investigating", "Dismissed", "SAR_Filed")
RAISED = ("Open", "Investigating", "SAR_Filed")
ALERTING = ("High", "Critical")


def trigger(fused: DataFrame) -> DataFrame:
    """Alerts of scored transactions: either level is High or Critical. Ids are digests, so that reruns agree."""
    hit = F.col("risk_level").isin(*ALERTING) | F.col("risk_level_group").isin(*ALERTING)
    return fused.where(hit).select(F.sha2(F.col("tx_id").cast("string"), 256).alias("alert_id"), "*", F.lit("Open").alias("status"), F.col("ts").alias("created_at"))


def set_status(changes: DataFrame, alert_id: str, status: str, at: str) -> DataFrame:
    """changes (alert_id, status, changed_at) with one more change."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    row = changes.sparkSession.createDataFrame([(alert_id, status, at)], "alert_id string, status string, at string")
    return changes.unionByName(row.select("alert_id", "status", F.to_timestamp("at").alias("changed_at")))


def with_status(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """alerts with the latest status of each."""
    last = changes.groupBy("alert_id").agg(F.max(F.struct("changed_at", "status")).alias("last")).select("alert_id", F.col("last.status").alias("new_status"))
    return alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def list_alerts(alerts: DataFrame, *, level: str | None = None, status: str | None = None, sender: int | None = None, limit: int = 200) -> DataFrame:
    """Alerts by filters, the latest first."""
    for c, value in (("risk_level", level), ("status", status), ("sender", sender)):
        if value is not None:
            alerts = alerts.where(F.col(c) == value)
    return alerts.orderBy(F.desc("created_at"), "alert_id").limit(limit)


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    """The alert of that id, or no row."""
    return alerts.where(F.col("alert_id") == alert_id)


def live_over_stored(stored: DataFrame, live: DataFrame, key: str = "tx_id") -> DataFrame:
    """Both by key; where both have a row, the live one."""
    both = live.withColumn("_source", F.lit(0)).unionByName(stored.withColumn("_source", F.lit(1)))
    first = F.row_number().over(W.partitionBy(key).orderBy("_source"))
    return both.withColumn("_rank", first).where(F.col("_rank") == 1).drop("_rank", "_source")
