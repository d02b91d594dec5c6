"""Registered queries: sources, event hygiene, similarity, rankings, model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.logs import (
    FLAGS,
    NOW,
    USAGE,
    catalog_props,
    full_log,
    interactions,
    order_log,
    property_log,
    usage_log,
)
from likewise import EngineParams, Indicator, Ranking
from likewise.functions.times import instant
from likewise.operators import events as ev
from likewise.operators import model as md
from likewise.operators import properties as pr
from likewise.operators import rankings as rk
from likewise.operators import similarity as sim
from likewise.operators.groups import deal
from likewise.operators.model import Model
from likewise.operators.querying import recent_history
from likewise.operators.stretches import StretchCounts
from likewise.plans.increments import PairCounts
from likewise.plans.train import clean_events, refresh_ranks, train, train_and_publish
from likewise.sources import store
from likewise.sources.delimited import parse_delimited_events, parse_ratings
from likewise.sources.staging import staged_path
from likewise.sources.tables import scan_events, usage_events

Query = Callable[[SparkSession, str], DataFrame]

#: The engine most checks use: three event types, all rankings that need no clock.
PARAMS = EngineParams.of(
    *USAGE,
    rankings=(
        Ranking("popular"),
        Ranking("trending", duration="30 days"),
        Ranking("userDefined"),
    ),
)

#: The larger engine: order lines, bigint ids, popularity only.
ORDER_PARAMS = EngineParams.of(*FLAGS)

_models: dict[tuple[str, str, str], Model] = {}


def trained(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Model]) -> Model:
    """Train once per application; queries on the same model share it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _models:
        _models[key] = make()
    return _models[key]


def usage_model(spark: SparkSession, sf_dir: str) -> Model:
    return trained(spark, sf_dir, "usage", lambda: train(full_log(spark, sf_dir), PARAMS, NOW))


def order_model(spark: SparkSession, sf_dir: str) -> Model:
    log = order_log(spark, sf_dir)
    return trained(spark, sf_dir, "orders", lambda: train(log, ORDER_PARAMS, "2005-01-01"))


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def text(ids: str | Column) -> Column:
    return F.array_join(F.col(ids) if isinstance(ids, str) else ids, "|")


def props_text(props: str = "props") -> Column:
    parts = F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("="), text(e["value"])))
    return F.array_join(F.array_sort(parts), ";")


def indicators(names: list[str], **limits) -> list[Indicator]:
    return [Indicator(n, **limits) for n in names]


# -- sources ----------------------------------------------------------------------


def scan_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_events(usage_log(spark, sf_dir), USAGE).select(
        "event", "entity_id", "target_entity_id", stamp("event_time").alias("moment"), "seq"
    )


def scan_events_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.events_between(
        usage_log(spark, sf_dir), "2024-01-10T06:00:00", "2024-01-20T18:30:00", ["purchase", "view"]
    )
    return found.select("event", "entity_id", "target_entity_id", stamp("event_time").alias("moment"), "seq")


def parse_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = usage_log(spark, sf_dir).select(
        F.concat_ws(",", "entity_id", "event", "target_entity_id").alias("value"), "seq"
    )
    described = catalog_props(spark, sf_dir).select(
        F.concat(
            "item", F.lit(",$set,tags:"), F.concat_ws(":", F.col("props")["tags"])
        ).alias("value"),
        (-F.col("item").cast("bigint") - 1).alias("seq"),
    )
    parsed = parse_delimited_events(usage.unionByName(described))
    return parsed.select(
        "event",
        "entity_type",
        "entity_id",
        F.coalesce("target_entity_id", F.lit("-")).alias("target"),
        F.coalesce(text(F.map_keys("properties")), F.lit("-")).alias("field"),
        F.coalesce(text(F.col("properties")["tags"]), F.lit("-")).alias("value_list"),
        "seq",
    )


def parse_ratings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_log(spark, sf_dir).select(
        F.concat_ws("::", "entity_id", "target_entity_id", F.col("seq") % 5 + 1).alias("value"), "seq"
    )
    kinds = [["garden", "tools"], ["garden", "seeds", "spring"]]
    return parse_ratings(lines, seed=3, categories=kinds).select(
        "event",
        "entity_type",
        "entity_id",
        F.coalesce("target_entity_id", F.lit("-")).alias("target"),
        F.coalesce(text(F.col("properties")["category"]), F.lit("-")).alias("category"),
        "seq",
    )


def recent_user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = usage_log(spark, sf_dir)
    params = EngineParams(tuple(indicators(USAGE)))
    asked = log.select(F.col("entity_id").alias("user")).distinct().withColumn("query_id", F.col("user"))
    return recent_history(asked, usage_events(log, USAGE), params).select(
        "user", "event", "item", stamp("event_time").alias("moment")
    )


def lookup_item_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = usage_model(spark, sf_dir)
    asked = model.items.select(F.col("item").alias("query_id"), "item").unionByName(
        model.items.select(
            F.concat(F.lit("no-"), "item").alias("query_id"), F.concat(F.lit("no-"), "item").alias("item")
        )
    )
    found = store.lookup_items(asked, model)
    return found.select(
        "query_id",
        *[F.coalesce(text(F.col("props")[e]), F.lit("")).alias(e) for e in USAGE],
        F.coalesce(text(F.col("props")["brand"]), F.lit("")).alias("brand"),
    )


# -- event hygiene ----------------------------------------------------------------


def moving_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ev.moving_window(usage_log(spark, sf_dir), "10 days")
    return kept.select("event", "entity_id", "target_entity_id", stamp("event_time").alias("moment"), "seq")


def dedup_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ev.dedup_events(usage_log(spark, sf_dir))
    return kept.select("event", "entity_id", "target_entity_id", stamp("event_time").alias("moment"))


#: All three ways of cleaning at once.
_CLEANING = EngineParams.of(
    *USAGE, event_window="10 days", dedup_events=True, compact_properties=True
)


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = usage_log(spark, sf_dir).unionByName(property_log(spark, sf_dir))
    return clean_events(log, _CLEANING, NOW)


def cleaned_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of ten days, de-duplication and compaction lose no property."""
    return pr.item_props(pr.aggregate_properties(_cleaned(spark, sf_dir)))


def cleaned_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = usage_events(_cleaned(spark, sf_dir), USAGE)
    return kept.select("user", "event", "item", stamp("event_time").alias("moment"))


def first_event_type_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained with a first event type that never occurs, and on a log with blank ids."""
    log = usage_log(spark, sf_dir)
    blank = log.where("seq % 7 = 0").withColumn("entity_id", F.lit(""))
    lost = log.where("seq % 11 = 0").withColumn("target_entity_id", F.lit(None).cast("string"))
    log = log.unionByName(blank).unionByName(lost)
    model = train(log, EngineParams.of("refund", *USAGE, recs_model="collabFiltering"), NOW)
    return _ranked(model.correlators.select("item", "event", "correlator", "llr", "rnk"))


def compact_properties_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.compact_properties(property_log(spark, sf_dir)).select(
        "event", "entity_id", props_text("properties").alias("props"), stamp("event_time").alias("moment")
    )


def aggregate_properties_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = pr.aggregate_properties(property_log(spark, sf_dir))
    return pr.item_props(props).select("item", "field", "value")


def split_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["wish", "view", "purchase", "click"]
    return ev.event_inventory(interactions(usage_log(spark, sf_dir)), names).select(
        "event", F.col("position").cast("bigint").alias("position"), "n"
    )


def validate_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of early events are blanked so that there is something to reject."""
    log = usage_log(spark, sf_dir)
    hour = F.hour("event_time")
    log = log.withColumn("entity_id", F.when(hour == 3, "").otherwise(F.col("entity_id"))).withColumn(
        "target_entity_id", F.when(hour == 4, F.lit(None)).otherwise(F.col("target_entity_id"))
    )
    good, bad = ev.validate_events(log, USAGE)
    return good.select("event", F.lit("accepted").alias("verdict")).unionByName(
        bad.select("event", F.col("reason").alias("verdict"))
    ).groupBy("event", "verdict").agg(F.count("*").alias("n"))


def min_events_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.min_events_filter(interactions(usage_log(spark, sf_dir)), "purchase", 13)


def restrict_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With purchases of few users left, most secondary events go."""
    log = interactions(usage_log(spark, sf_dir))
    counts = ev.interaction_counts(log)
    few = ev.active_users(counts, "purchase", 16)
    rare = log.where("event <> 'purchase'").unionByName(
        log.where("event = 'purchase'").join(few, "user", "left_semi")
    )
    return ev.restrict_secondary_users(rare, "purchase").groupBy("user", "event", "item").agg(
        F.count("*").alias("n")
    )


def binarize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.binarize(interactions(order_log(spark, sf_dir)))


def downsample_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ev.binarize(interactions(order_log(spark, sf_dir)))
    return ev.downsample(log, indicators(FLAGS, max_items_per_user=8), seed=7)


def project_item_fields_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.project_item_fields(catalog_props(spark, sf_dir))


def coerce_property_types_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = pr.item_props(catalog_props(spark, sf_dir))
    typed = pr.coerce_property_types(long, ["date", "available", "expires"])
    return typed.withColumn("date_value", stamp("date_value"))


def field_inventory_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = catalog_props(spark, sf_dir).unionByName(
        pr.aggregate_properties(property_log(spark, sf_dir))
    )
    return pr.field_inventory(both)


# -- similarity -------------------------------------------------------------------


def _cut_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ev.prepare(interactions(order_log(spark, sf_dir)), indicators(FLAGS))


def _cut_usage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ev.prepare(interactions(usage_log(spark, sf_dir)), indicators(USAGE), min_events=9)


def cooccurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.cooccurrence_counts(_cut_orders(spark, sf_dir)[0], "N")


def cross_occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.cross_occurrence_counts(_cut_orders(spark, sf_dir)[0], "N")


def llr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, users = _cut_usage(spark, sf_dir)
    return sim.llr_scores(sim.pair_counts(cut, "purchase"), users).select(
        "item", "event", "correlator", "n_both", "n_item", "n_correlator", "llr"
    )


def llr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, users = _cut_usage(spark, sf_dir)
    scored = sim.llr_scores(sim.pair_counts(cut, "purchase"), users)
    least = [Indicator("purchase", min_llr=0.5), Indicator("view", min_llr=2.0), Indicator("click")]
    return sim.llr_threshold(scored, least).select("item", "event", "correlator", "llr")


def _ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("rnk", F.col("rnk").cast("bigint"))


def top_correlators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(sim.correlators(interactions(order_log(spark, sf_dir)), indicators(FLAGS, max_correlators=10)))


def incremental_correlators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage log in three batches; the second brings users' events twice, the third takes one back."""
    log = interactions(usage_log(spark, sf_dir)).withColumn("n", F.lit(1).cast("bigint"))
    part = F.pmod(F.xxhash64("user", "event", "item"), F.lit(3))
    twice = log.where(part == 2).withColumn("n", F.lit(2).cast("bigint"))
    kept = PairCounts(spark, staged_path(spark, "pairs"), indicators(USAGE))
    kept.apply(0, log.where(part == 0))
    kept.apply(1, log.where(part == 1).unionByName(twice))
    kept.apply(2, log.where(part == 2).withColumn("n", F.lit(-1).cast("bigint")))
    return _ranked(kept.correlators())


def per_indicator_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = [
        Indicator("purchase", max_correlators=4),
        Indicator("view", max_correlators=7, min_llr=1.0),
        Indicator("click", max_correlators=3),
    ]
    return _ranked(sim.correlators(interactions(usage_log(spark, sf_dir)), limits))


def correlator_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sim.correlators(interactions(usage_log(spark, sf_dir)), indicators(USAGE), min_events=5)
    return sim.correlator_lists(found).select("item", "event", text("correlators").alias("correlators"))


# -- rankings ---------------------------------------------------------------------

_START, _END = instant("2024-01-02T00:00:00"), instant("2024-01-30T12:00:00")


def rank_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.rank_popular(usage_log(spark, sf_dir), ["purchase", "view"], _START, _END)


def rank_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.rank_trending(usage_log(spark, sf_dir), USAGE, _START, _END)


def rank_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.rank_hot(usage_log(spark, sf_dir), USAGE, _START, _END)


def rank_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.rank_random(usage_log(spark, sf_dir), catalog_props(spark, sf_dir), _START, _END, seed=9)


def rank_user_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.rank_user_defined(catalog_props(spark, sf_dir), "userRank")


def _all_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = [
        Ranking("popular", event_names=("purchase",)),
        Ranking("trending", event_names=("view",), duration="30 days"),
        Ranking("hot", event_names=("click", "view"), duration="30 days"),
        Ranking("userDefined"),
        Ranking("random", duration="30 days"),
    ]
    return rk.rank_table(rankings, usage_log(spark, sf_dir), catalog_props(spark, sf_dir), NOW, seed=9)


def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_ranks(spark, sf_dir)


def velocity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trending on the larger log: two halves of a ten-year window in one scan."""
    return rk.rank_trending(order_log(spark, sf_dir), FLAGS, instant("1994-01-01"), instant("2004-01-01"))


# -- joins and model --------------------------------------------------------------


def join_props_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = pr.aggregate_properties(property_log(spark, sf_dir))
    joined = md.join_props_ranks(props, _all_ranks(spark, sf_dir).select("item", "popRank", "trendRank"))
    return joined.select("item", props_text().alias("props"), "popRank", "trendRank")


def merge_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog, then the folded property log, then a newer brand for half the items."""
    newer = catalog_props(spark, sf_dir).select(
        "item",
        F.map_filter("props", lambda k, v: (k == "brand") & (F.get(v, F.lit(0)) > "Brand#2")).alias("props"),
    )
    newer = newer.select(
        "item", F.transform_values("props", lambda k, v: F.array(F.lit("new"))).alias("props")
    )
    merged = md.merge_model(
        [catalog_props(spark, sf_dir), pr.aggregate_properties(property_log(spark, sf_dir)), newer]
    )
    return merged.select("item", props_text().alias("props"))


def user_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = interactions(order_log(spark, sf_dir))
    users = ev.active_users(ev.interaction_counts(log), "N", 18)
    return log.where("event <> 'N'").join(users, "user", "left_semi").groupBy("user", "event").agg(
        F.count("*").alias("n")
    )


def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = usage_model(spark, sf_dir)
    found = model.postings.select("field", "term", F.explode("places").alias("pos"))
    # the join's tasks sort what they join by term: their number is fixed by the places
    counted = deal(found, "pos").join(model.items, "pos").groupBy("field", "term").agg(
        F.count("*").alias("n_items"), F.min("item").alias("first_item")
    )
    return counted.join(model.weights, ["field", "term"]).select(
        "field", "term", "n_items", "first_item", "df", F.round("idf", 6).alias("idf")
    )


def _documents(model: Model) -> DataFrame:
    return model.documents().select("item", props_text().alias("props"))


def load_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish, read back what is current."""
    path = staged_path(spark, "store")
    store.publish(usage_model(spark, sf_dir), path)
    return store.load_documents(spark, path).select("item", props_text().alias("props"))


def publish_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions, the second without the first's correlators; readers see the second."""
    path = staged_path(spark, "store")
    model = usage_model(spark, sf_dir)
    store.publish(model, path)
    bare = md.empty_correlators(spark, model.items.schema["item"].dataType)
    described = model.items.select("item", "props")
    entries = md.index_terms(None, described)
    weights = md.term_weights(entries, None, described)
    postings = md.build_postings(entries, weights, model.items)
    store.publish(Model(bare, model.items, postings, weights), path)
    return _documents(store.load(spark, path))


def sink_parallelism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by at most two tasks per table; the content is the same."""
    path = staged_path(spark, "store")
    train_and_publish(full_log(spark, sf_dir), replace(PARAMS, max_write_tasks=2), path, NOW)
    read = store.load(spark, path).correlators
    files = read.select(F.input_file_name().alias("f")).distinct()
    return read.groupBy("event").agg(F.count("*").alias("n")).withColumn(
        "few_files", files.agg(F.count("*")).scalar() <= 2
    )


def stretch_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three counted rankings from stretches of six hours, counted in three steps."""
    log = usage_log(spark, sf_dir)
    counts = StretchCounts(spark, staged_path(spark, "stretches"), 6 * 3600)
    for upto in ("2024-01-10T07:00:00", "2024-01-21T00:00:00", "2024-01-28T13:30:00"):
        counts.update(log, datetime.fromisoformat(upto))
    rankings = [
        Ranking("popular", event_names=("view",), duration="20 days"),
        Ranking("trending", event_names=("view",), duration="20 days"),
        Ranking("hot", event_names=("view",), duration="20 days"),
    ]
    none = spark.createDataFrame([], "item string, props map<string,array<string>>")
    return rk.rank_table(rankings, log, none, NOW, stored=counts)


def refresh_ranks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of a shorter window and the folded properties, on the trained model."""
    log = usage_log(spark, sf_dir).unionByName(property_log(spark, sf_dir))
    params = EngineParams.of(
        *USAGE, rankings=(Ranking("popular", event_names=("view",), duration="7 days"),)
    )
    fresh = refresh_ranks(usage_model(spark, sf_dir), log, params, NOW)
    lists = md.correlator_fields(fresh.correlators).select("item", F.col("props")["view"].alias("view"))
    return fresh.items.join(lists, "item", "left").select(
        "item", props_text().alias("props"), "popRank", "pos", F.coalesce(text("view"), F.lit("")).alias("view")
    )


QUERIES: dict[str, Query] = {
    "scan_events": scan_events_query,
    "scan_events_window": scan_events_window,
    "parse_delimited_events": parse_delimited,
    "parse_ratings": parse_ratings_query,
    "recent_user_history": recent_user_history,
    "lookup_item_model": lookup_item_model,
    "load_model": load_model,
    "moving_event_window": moving_event_window,
    "dedup_events": dedup_events_query,
    "cleaned_properties": cleaned_properties,
    "cleaned_usage": cleaned_usage,
    "first_event_type_empty": first_event_type_empty,
    "compact_properties": compact_properties_query,
    "split_by_event": split_by_event,
    "aggregate_properties": aggregate_properties_query,
    "validate_events": validate_events_query,
    "min_events_filter": min_events_filter_query,
    "restrict_secondary_users": restrict_secondary,
    "binarize": binarize_query,
    "downsample_interactions": downsample_interactions,
    "project_item_fields": project_item_fields_query,
    "coerce_property_types": coerce_property_types_query,
    "field_inventory": field_inventory_query,
    "cooccurrence_counts": cooccurrence_counts,
    "cross_occurrence_counts": cross_occurrence_counts,
    "llr_score": llr_score,
    "llr_threshold": llr_threshold,
    "top_correlators": top_correlators,
    "per_indicator_params": per_indicator_params,
    "correlator_lists": correlator_lists,
    "rank_popular": rank_popular,
    "rank_trending": rank_trending,
    "rank_hot": rank_hot,
    "rank_random": rank_random,
    "rank_user_defined": rank_user_defined,
    "rank_table": rank_table,
    "join_props_ranks": join_props_ranks,
    "merge_model": merge_model,
    "velocity_join": velocity_join,
    "user_semi_join": user_semi_join,
    "publish_model": publish_model,
    "sink_parallelism": sink_parallelism,
    "refresh_ranks": refresh_ranks_query,
    "incremental_correlators": incremental_correlators,
    "stretch_ranks": stretch_ranks,
    "build_postings": build_postings,
}
