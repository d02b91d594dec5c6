"""Registered queries: the event table read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.logs import as_usage, table
from checks.sql_parts import LOG, ctes
from checks.training import Query
from likewise.sources.staging import staged_path
from likewise.streaming.log import (
    read_event_stream,
    run_to_latest,
    run_to_table,
    stream_dedup_events,
    stream_popularity,
)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return as_usage(read_event_stream(spark, sf_dir, schema, "events.parquet"))


def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts, those of days that are still open as they stand."""
    counted = stream_popularity(_stream(spark, sf_dir), ["purchase", "view"], "1 day", "2 hours")
    done = run_to_latest(
        counted, ["start", "item"], staged_path(spark, "stream"), staged_path(spark, "progress")
    )
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "item", "rank")


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stream_dedup_events(_stream(spark, sf_dir), "40 days").select(
        "event", "entity_id", "target_entity_id", "event_time"
    )
    done = run_to_table(kept, staged_path(spark, "stream"), staged_path(spark, "progress"))
    return done.select("event", "entity_id", "target_entity_id")


QUERIES: dict[str, Query] = {"stream_popularity": popularity, "stream_dedup_events": dedup}

SQL: dict[str, str] = {
    "stream_popularity": f"""{ctes(LOG)}
        SELECT strftime(date_trunc('day', t), '%Y-%m-%d') AS day, i AS item, CAST(count(*) AS DOUBLE) AS rank
        FROM log WHERE e IN ('purchase', 'view')
        GROUP BY date_trunc('day', t), i""",
    "stream_dedup_events": f"""{ctes(LOG)}
        SELECT DISTINCT e AS event, u AS entity_id, i AS target_entity_id FROM log""",
}
