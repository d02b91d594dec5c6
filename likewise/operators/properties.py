"""Item properties: folding the property log, types, and the field inventory.

Property events are rows of the event log with ``entity_type = 'item'`` and event
``$set``, ``$unset`` or ``$delete``; ``properties`` is a map<string, array<string>>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.operators.groups import deal
from likewise.params import RANKING_NAMES

# The events of the property log.
SET, UNSET, DELETE = "$set", "$unset", "$delete"


def property_events(events: DataFrame) -> DataFrame:
    """The property log's part of an event log."""
    return events.where(
        (F.col("entity_type") == "item") & F.col("event").isin(SET, UNSET, DELETE)
    ).select(F.col("entity_id").alias("item"), "event", "properties", "event_time", "seq")


def _latest(events: DataFrame) -> DataFrame:
    """(item, props): the last value of every property still set, by (time, seq).

    Two map-side-combined aggregations: last writer per (item, property), then one row
    per item. An item with any number of property events shrinks to one row per
    property name before it is gathered. Events are dealt out one by one before they
    become a row per property, so neither a small file of many items nor an item of very
    many events is sorted by one task.
    """
    log = deal(property_events(events), "item", "event_time", "seq")
    log = log.withColumn("at", F.struct("event_time", "seq"))
    # One pass over the log: a $delete names no property, and an item whose only event is an
    # empty $set still exists, without properties; both are rows with a NULL field.
    named = F.when(F.col("event") != DELETE, F.col("properties"))
    last = (
        log.select("item", "event", "at", F.explode_outer(named).alias("field", "value"))
        .groupBy("item", "field")
        .agg(
            F.max_by(F.struct((F.col("event") == SET).alias("is_set"), "value"), "at").alias("last"),
            F.max("at").alias("at"),
            F.max(F.when(F.col("event") == SET, F.col("at"))).alias("set_at"),
            F.max(F.when(F.col("event") == DELETE, F.col("at"))).alias("gone_at"),
        )
    )
    return (
        last.groupBy("item")
        .agg(
            F.max("gone_at").alias("gone_at"),
            F.max("set_at").alias("set_at"),
            F.collect_list(
                F.when(
                    F.col("field").isNotNull() & F.col("last.is_set"),
                    F.struct("field", F.col("last.value").alias("value"), "at"),
                )
            ).alias("fields"),
        )
        .where(
            F.col("set_at").isNotNull()
            & (F.col("gone_at").isNull() | (F.col("set_at") > F.col("gone_at")))
        )
        .select(
            "item",
            F.filter(
                "fields", lambda f: F.col("gone_at").isNull() | (f["at"] > F.col("gone_at"))
            ).alias("fields"),
            "set_at",
        )
    )


def aggregate_properties(events: DataFrame) -> DataFrame:
    """(item, props): effective properties after all $set, $unset and $delete events."""
    entry = F.transform("fields", lambda f: F.struct(f["field"], f["value"]))
    return _latest(events).select("item", F.map_from_entries(entry).alias("props"))


def compact_properties(events: DataFrame) -> DataFrame:
    """The property log folded to one $set event per item, at its last change."""
    entry = F.transform("fields", lambda f: F.struct(f["field"], f["value"]))
    return _latest(events).select(
        F.lit(SET).alias("event"),
        F.lit("item").alias("entity_type"),
        F.col("item").alias("entity_id"),
        F.map_from_entries(entry).alias("properties"),
        F.col("set_at.event_time").alias("event_time"),
        F.col("set_at.seq").alias("seq"),
    )


def item_props(props: DataFrame) -> DataFrame:
    """Long form: one row (item, field, value) per value."""
    return props.select("item", F.explode("props").alias("field", "values")).select(
        "item", "field", F.explode("values").alias("value")
    )


def project_item_fields(props: DataFrame) -> DataFrame:
    """(item, fields): the raw property map as JSON text, names in order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries("props")))
    return props.select("item", F.to_json(ordered).alias("fields"))


def field_inventory(props: DataFrame) -> DataFrame:
    """Distinct property names over all items."""
    return props.select(F.explode(F.map_keys("props")).alias("field")).distinct()


def coerce_property_types(
    long_props: DataFrame,
    date_names: Sequence[str],
    rank_names: Sequence[str] = tuple(RANKING_NAMES.values()),
) -> DataFrame:
    """Typed columns beside each text value: date, double, int, bool or string.

    A configured date name is a timestamp and a built-in ranking name a double; other
    scalars are what their JSON text says, an integer, a fraction, a truth value, or
    else a string. Exactly one typed column is filled per row, ``kind`` names it.
    """
    value = F.col("value")
    kind = (
        F.when(F.col("field").isin(list(date_names)), F.lit("date"))
        .when(F.col("field").isin(list(rank_names)), F.lit("double"))
        .when(value.rlike(r"^-?(0|[1-9][0-9]{0,17})$"), F.lit("int"))
        .when(value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.lit("double"))
        .when(value.isin("true", "false"), F.lit("bool"))
        .otherwise(F.lit("string"))
    )

    def typed(name: str, cast: Column) -> Column:
        return F.when(F.col("kind") == name, cast)

    return long_props.withColumn("kind", kind).select(
        "item",
        "field",
        "kind",
        typed("date", F.try_to_timestamp(value)).alias("date_value"),
        typed("double", value.try_cast("double")).alias("double_value"),
        typed("int", value.try_cast("bigint")).alias("int_value"),
        typed("bool", value.try_cast("boolean")).alias("bool_value"),
        typed("string", value).alias("string_value"),
    )
