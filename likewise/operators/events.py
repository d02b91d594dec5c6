"""Event hygiene, and the preparation of usage events for similarity."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likewise.functions.hashing import shuffle_key
from likewise.functions.times import duration, instant, instant_literal
from likewise.operators.groups import SHARDS, top_per_group
from likewise.params import Indicator
from likewise.sources.staging import stage

LOG_KEY = ["event", "entity_type", "entity_id", "target_entity_type", "target_entity_id"]

#: Stands for no cap beside other indicators' caps.
NO_CAP = (1 << 31) - 1


def is_property_event() -> Column:
    """Rows of the property log, which says what items are and not what users did."""
    return (F.col("entity_type") == "item") & F.col("event").isin("$set", "$unset", "$delete")


def properties_text() -> Column:
    """An event's properties in an order of their own, as maps are no grouping keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties"))))


def events_between(
    events: DataFrame,
    start: datetime | str,
    end: datetime | str,
    names: Sequence[str] = (),
) -> DataFrame:
    """Events with ``start <= event_time < end``, of the given names if any."""
    kind = events.schema["event_time"].dataType
    inside = (F.col("event_time") >= instant_literal(start, kind)) & (
        F.col("event_time") < instant_literal(end, kind)
    )
    return events.where(inside & F.col("event").isin(list(names)) if names else inside)


def moving_window(events: DataFrame, window: str, end: datetime | str | None = None) -> DataFrame:
    """Leave out events older than ``window`` before ``end`` (default: the newest event).

    Property events stay however old they are: an item is what was last said of it. Returns
    a filtered view; the log itself is never altered.
    """
    at = F.col("event_time")
    if end is not None:
        kind = events.schema["event_time"].dataType
        recent = at >= instant_literal(instant(end) - duration(window), kind)
    else:
        recent = at >= events.agg(F.max("event_time")).scalar() - F.lit(duration(window))
    return events.where(F.coalesce(is_property_event(), F.lit(False)) | recent)


def dedup_events(events: DataFrame) -> DataFrame:
    """One event per (name, entity, target, properties): the newest of identical ones."""
    rest = [c for c in events.columns if c not in LOG_KEY]
    newest = F.max_by(F.struct(*rest), F.struct("event_time", "seq")).alias("_kept")
    # the key holds every distinguishing column, so repeats shrink before the shuffle
    return events.groupBy(*LOG_KEY, properties_text()).agg(newest).select(
        *[F.col("_kept")[c].alias(c) if c in rest else F.col(c) for c in events.columns]
    )


def validate_events(events: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) usage events; rejected ones carry a ``reason``."""
    reason = (
        F.when(~F.col("event").isin(list(names)), F.lit("unexpected event"))
        .when(F.coalesce(F.length(F.col("entity_id").cast("string")), F.lit(0)) == 0, F.lit("empty user"))
        .when(
            F.coalesce(F.length(F.col("target_entity_id").cast("string")), F.lit(0)) == 0,
            F.lit("empty item"),
        )
    )
    judged = events.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(
        F.col("reason").isNotNull()
    )


def event_inventory(interactions: DataFrame, names: Sequence[str]) -> DataFrame:
    """(event, position, n): event types that occur, in configured order from 1.

    Types without events are dropped, so position 1 is the first non-empty type.
    """
    order = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    found = (
        interactions.where(F.col("event").isin(list(names)))
        .groupBy("event")
        .agg(F.count("*").alias("n"))
    )
    # one row per configured event type
    place = F.row_number().over(Window.orderBy(order[F.col("event")]))
    return found.select("event", place.alias("position"), "n")


def interaction_counts(interactions: DataFrame) -> DataFrame:
    """Distinct (user, event, item) with ``n_events``, the raw number behind each.

    The full triple is the shuffle key and repeats are combined before it, so neither
    a busy user nor a popular item forms a hot partition.
    """
    return interactions.groupBy("user", "event", "item").agg(F.count("*").alias("n_events"))


def binarize(interactions: DataFrame) -> DataFrame:
    """Repeated (user, event, item) collapse to one row."""
    return interactions.select("user", "event", "item").distinct()


def active_users(counts: DataFrame, primary: str, min_events: int | None = None) -> DataFrame:
    """Users with a primary event, or with at least ``min_events`` raw primary events."""
    users = (
        counts.where(F.col("event") == primary)
        .groupBy("user")
        .agg(F.sum("n_events").alias("n_events"))
    )
    return users.where(F.col("n_events") >= (min_events or 1)).select("user")


def min_events_filter(interactions: DataFrame, primary: str, n: int | None) -> DataFrame:
    """Primary events of users having at least ``n`` of them, repeats counted."""
    counts = interaction_counts(interactions.where(F.col("event") == primary))
    users = active_users(counts, primary, n)
    return counts.join(users, "user", "left_semi").select("user", "event", "item")


def restrict_secondary_users(interactions: DataFrame, primary: str) -> DataFrame:
    """Secondary events of users who have a primary event."""
    users = interactions.where(F.col("event") == primary).select("user").distinct()
    return interactions.where(F.col("event") != primary).join(users, "user", "left_semi")


def _cap_of(indicators: Sequence[Indicator]) -> tuple[Column, int]:
    most = {i.name: i.max_items_per_user or NO_CAP for i in indicators}
    caps = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    return caps[F.col("event")], max(most.values())


def cap_per_user(
    interactions: DataFrame, indicators: Sequence[Indicator], seed: int = 0
) -> DataFrame:
    """At most ``max_items_per_user`` items per user and event type, a fixed random choice."""
    cap, widest = _cap_of(indicators)
    kept = top_per_group(
        interactions,
        ["user", "event"],
        [shuffle_key(seed, F.col("user"), F.col("item")), F.col("item")],
        widest,
        shards=SHARDS,  # the rows may come from a join on the user
    )
    return kept.where(F.col("rnk") <= cap).drop("rnk")


def _cap_large_baskets(
    interactions: DataFrame, indicators: Sequence[Indicator], seed: int
) -> DataFrame:
    """:func:`cap_per_user`, sorting only the rows of users who exceed a cap.

    Most users do not, and their rows stay where they are: the table of those who do is
    staged, and small enough to be broadcast unless they are very many.
    """
    cap, _ = _cap_of(indicators)
    sizes = interactions.groupBy("user", "event").agg(F.count("*").alias("n"))
    over = stage(sizes.where(F.col("n") > cap).select("user", "event"), "over")
    if over.isEmpty():
        return interactions
    key = ["user", "event"]
    large = cap_per_user(interactions.join(over, key, "left_semi"), indicators, seed)
    return interactions.join(over, key, "left_anti").unionByName(large)


def cap_per_item(
    interactions: DataFrame, indicators: Sequence[Indicator], seed: int = 0
) -> DataFrame:
    """At most ``max_items_per_user`` users per target and event type; adds ``n_users``."""
    cap, widest = _cap_of(indicators)
    kept = top_per_group(
        interactions,
        ["event", "item"],
        [shuffle_key(seed, F.col("user"), F.col("item")), F.col("user")],
        widest,
    )
    return with_margins(kept.where(F.col("rnk") <= cap).drop("rnk"))


def with_margins(interactions: DataFrame) -> DataFrame:
    """Adds ``n_users``, how many users a target has: the margin of the similarity test.

    Counts combine before their shuffle, and the join meets one row per target, so a target
    that a third of the log goes to can be split on the other side.
    """
    margins = interactions.groupBy("event", "item").agg(F.count("*").alias("n_users"))
    return interactions.join(margins, ["event", "item"])


def downsample(
    interactions: DataFrame, indicators: Sequence[Indicator], seed: int = 0
) -> DataFrame:
    """The interaction cut: caps per user, then per target, by a seeded hash order.

    A sampling operator for callers that want one; nothing else applies it unasked.
    """
    return cap_per_item(cap_per_user(interactions, indicators, seed), indicators, seed)


def prepare(
    interactions: DataFrame,
    indicators: Sequence[Indicator],
    min_events: int | None = None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(interactions, users) ready for similarity.

    ``users`` are those with enough primary events; their number is the N of the
    similarity test. The interactions are theirs only, distinct, with ``n_users`` per
    target. All of them are kept, unless an indicator has a cap: then the interaction cut is
    applied, per user before the join with ``users`` (it does not depend on other users and
    gives the same rows as after it). Interactions and ``users`` are staged, so that the log is read once, and the true
    size of ``users`` decides whether the join with them needs a shuffle.
    """
    names = [i.name for i in indicators]
    primary = names[0]
    log = interactions.where(F.col("event").isin(names))
    counts = stage(interaction_counts(log), "interactions")
    users = stage(active_users(counts, primary, min_events), "users")
    pairs = counts.select("user", "event", "item")
    if all(i.max_items_per_user is None for i in indicators):
        return with_margins(pairs.join(users, "user", "left_semi")), users
    capped = _cap_large_baskets(pairs, indicators, seed)
    return cap_per_item(capped.join(users, "user", "left_semi"), indicators, seed), users
