"""Scans of an event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event log stored as Parquet; partition it by date to prune time ranges."""
    return spark.read.parquet(path)


def scan_events(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """User-to-item events of the given names; all three conditions reach the scan."""
    return events.where(
        F.col("event").isin(list(names))
        & (F.col("entity_type") == "user")
        & (F.col("target_entity_type") == "item")
    )


def usage_events(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """(user, event, item, event_time) of user-to-item events whose two ids are not empty."""
    full = [F.length(F.col(c).cast("string")) > 0 for c in ("entity_id", "target_entity_id")]
    return scan_events(events, names).where(full[0] & full[1]).select(
        F.col("entity_id").alias("user"),
        "event",
        F.col("target_entity_id").alias("item"),
        "event_time",
    )
