"""Training: from the event log to the item model."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likewise.functions.times import instant
from likewise.operators.bitmaps import build_bitmaps
from likewise.operators.events import (
    dedup_events,
    event_inventory,
    is_property_event,
    moving_window,
)
from likewise.operators.model import (
    PROPS,
    Model,
    build_postings,
    empty_correlators,
    index_terms,
    item_table,
    merge_model,
    term_weights,
)
from likewise.operators.properties import aggregate_properties, compact_properties
from likewise.operators.rankings import rank_table
from likewise.operators.stretches import StretchCounts
from likewise.operators.similarity import correlators
from likewise.params import EngineParams
from likewise.sources.staging import passing_shuffles, stage, stage_parts
from likewise.sources.store import publish
from likewise.sources.tables import usage_events


def clean_events(
    events: DataFrame, params: EngineParams, end: datetime | str | None = None
) -> DataFrame:
    """The log as training sees it: aged out, de-duplicated and compacted where configured.

    Users' events without both ids are left out. No item loses a property by it. What any of
    the three has changed is written once, for all the jobs that read it.
    """
    columns = events.columns
    named = [F.length(F.col(c).cast("string")) > 0 for c in ("entity_id", "target_entity_id")]
    to_item = (F.col("entity_type") == "user") & (F.col("target_entity_type") == "item")
    events = events.where(~F.coalesce(to_item, F.lit(False)) | F.coalesce(named[0] & named[1], F.lit(False)))
    if params.event_window:
        events = moving_window(events, params.event_window, end)
    if params.dedup_events:
        events = dedup_events(events)
    if params.compact_properties:
        own = F.coalesce(is_property_event(), F.lit(False))
        compact = compact_properties(events).withColumn(
            "entity_id", F.col("entity_id").cast(events.schema["entity_id"].dataType)
        )
        events = events.where(~own).unionByName(compact, allowMissingColumns=True).select(*columns)
    cleaned = params.event_window or params.dedup_events or params.compact_properties
    return stage(events, "cleaned") if cleaned else events


def present_events(events: DataFrame, params: EngineParams) -> EngineParams:
    """``params`` with the event types that occur: the first of them is the primary one."""
    usage = usage_events(events, params.event_names)
    with passing_shuffles(events.sparkSession):
        found = event_inventory(usage, params.event_names).collect()  # a row per configured type
    return params.with_events({r["event"] for r in found})


def _assemble(
    found: DataFrame, props: DataFrame, ranks: DataFrame | None, params: EngineParams
) -> Model:
    spark = found.sparkSession
    items = stage_parts(spark, [lambda: item_table(props, ranks, found, params.date_columns)], "items")
    described = items.select("item", "props")
    entries = index_terms(found, described)
    weights = stage(term_weights(entries, found, described), "weights")
    postings = stage_parts(spark, [lambda: build_postings(entries, weights, items)], "postings")
    bitmaps = stage(build_bitmaps(postings, weights, items, params.event_names), "bitmaps")
    return Model(found, items, postings, weights, bitmaps)


def train(events: DataFrame, params: EngineParams, end: datetime | str | None = None) -> Model:
    """Learn correlators and rankings as ``params.recs_model`` says.

    The primary event type is the first configured one that has events; users and items
    without an id are left out. "all" learns both, "collabFiltering" no rankings, "backfill" no correlators. Item
    properties are kept in every mode. The tables of the model are written to the
    shared folder as they are finished; ``publish`` gives them a permanent place.
    """
    events = clean_events(events, params, end)
    params = present_events(events, params)
    item_type = events.schema["target_entity_id"].dataType
    props = stage(aggregate_properties(events), "props")
    props = props.select(F.col("item").cast(item_type).alias("item"), F.col("props").cast(PROPS))
    if params.recs_model == "backfill":
        found = empty_correlators(events.sparkSession, item_type)
    else:
        usage = usage_events(events, params.event_names)
        learn = partial(
            correlators,
            usage.select("user", "event", "item"),
            params.indicators,
            params.min_events_per_user,
            params.seed,
        )
        found = stage_parts(events.sparkSession, [learn], "correlators")
    ranks = None
    if params.recs_model != "collabFiltering":
        ranks = rank_table(
            params.active_rankings, events, props, end, params.seed, params.catalog_only
        )
    return _assemble(found, props, ranks, params)


def train_and_publish(
    events: DataFrame, params: EngineParams, path: str, end: datetime | str | None = None
) -> int:
    """Train, and publish the model with no more writers than ``params.max_write_tasks``."""
    return publish(train(events, params, end), path, max_write_tasks=params.max_write_tasks)


def refresh_ranks(
    model: Model,
    events: DataFrame,
    params: EngineParams,
    end: datetime | str | None = None,
    stored: StretchCounts | None = None,
) -> Model:
    """New rankings and properties on an existing model; its correlators stay.

    Newer properties win over the stored ones, name by name. With ``stored`` counts by stretch of
    time, which are brought up to ``end`` first, ``events`` need only hold what is not in them and
    the edges of the rankings' windows; they are taken as they are, so an engine that cleans its
    log has to count a clean one.
    """
    if stored is not None:
        if params.event_window or params.dedup_events:
            raise ValueError("counts by stretch of time are of a log that is not cleaned afterwards")
        if end is not None:
            stored.update(events, instant(end))
    events = clean_events(events, params, end)
    params = present_events(events, params)
    item_type = model.items.schema["item"].dataType
    fresh = aggregate_properties(events).select(F.col("item").cast(item_type).alias("item"), "props")
    fresh = stage(fresh, "fresh-props")
    known = model.items.select("item", F.col("props").cast(PROPS).alias("props"))
    props = stage(merge_model([known, fresh]), "props")
    ranks = rank_table(
        params.active_rankings, events, fresh, end, params.seed, params.catalog_only, stored
    )
    return _assemble(model.correlators, props, ranks, params)
