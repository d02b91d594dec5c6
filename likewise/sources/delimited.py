"""Event logs kept as delimited text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.functions.hashing import uniform


def _line() -> Column:
    """The text without its line end."""
    return F.regexp_replace("value", "[\\r\\n]+$", "")


def parse_delimited_events(
    lines: DataFrame,
    time: Column | None = None,
    field_separator: str = ",",
    value_separator: str = ":",
) -> DataFrame:
    """``user,event,target`` and ``item,$set,name:v1:v2`` lines as one event log.

    ``lines`` has the text in ``value`` and a line number in ``seq``; ``time`` gives a
    line's moment. A value list belongs to the name before it; ids may hold blanks. Lines
    with fewer than three parts are left to :func:`rejected_lines`.
    """
    part = F.split(_line(), field_separator, -1)
    pieces = F.split(F.get(part, F.lit(2)), value_separator, -1)
    is_set = F.get(part, F.lit(1)) == "$set"
    cut = lines.select(
        "*", part.alias("_part"), pieces.alias("_pieces"), is_set.alias("_set")
    ).where(F.size("_part") >= 3)
    values = F.slice("_pieces", 2, F.greatest(F.size("_pieces") - 1, F.lit(0)))
    return cut.select(
        F.col("_part")[1].alias("event"),
        F.when(F.col("_set"), "item").otherwise("user").alias("entity_type"),
        F.col("_part")[0].alias("entity_id"),
        F.when(~F.col("_set"), "item").alias("target_entity_type"),
        F.when(~F.col("_set"), F.col("_part")[2]).alias("target_entity_id"),
        F.when(F.col("_set"), F.create_map(F.col("_pieces")[0], values)).alias("properties"),
        (F.lit(None).cast("timestamp") if time is None else time).alias("event_time"),
        "seq",
    )


def rejected_lines(lines: DataFrame, separator: str, parts: int) -> DataFrame:
    """(value, seq, reason) of the lines that a parser asking for so many parts leaves out."""
    found = F.size(F.split(_line(), separator, -1))
    reason = F.when(F.col("value").isNull(), "no text").when(
        found < parts, F.concat_ws(" ", F.lit("found"), found, F.lit("of"), F.lit(parts), F.lit("parts"))
    )
    return lines.select("value", "seq", reason.alias("reason")).where(F.col("reason").isNotNull())


def default_ranks(events: DataFrame, name: str = "defaultRank") -> DataFrame:
    """(item, rank): the one property that is a number rather than a list."""
    first = F.get(F.col("properties")[name], F.lit(0))
    return events.where(F.col("properties")[name].isNotNull()).select(
        F.col("entity_id").alias("item"), first.try_cast("double").alias("rank")
    )


def parse_ratings(
    lines: DataFrame,
    seed: int = 0,
    separator: str = "::",
    categories: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """``user::item::rating`` lines as usage events, and a ``$set`` each if there are categories.

    The rating is ignored. Lines without two ids are left to :func:`rejected_lines`. Whether a
    line counts as "rate" or "buy", and which of the lists of ``categories`` its item gets, is drawn
    from the line's text and number, so that it repeats.
    """
    part = F.split(_line(), separator, -1)
    cut = lines.select("value", "seq", part.alias("_part")).where(F.size("_part") >= 2)
    buys = uniform(seed, F.col("value"), F.col("seq")) < 0.5
    drawn = uniform(seed + 1, F.col("value"), F.col("seq"))
    usage = cut.select(
        F.when(buys, "buy").otherwise("rate").alias("event"),
        F.lit("user").alias("entity_type"),
        F.col("_part")[0].alias("entity_id"),
        F.lit("item").alias("target_entity_type"),
        F.col("_part")[1].alias("target_entity_id"),
        F.lit(None).cast("map<string,array<string>>").alias("properties"),
        "seq",
    )
    if not categories:
        return usage
    lists = F.array(*[F.array(*[F.lit(c) for c in own]) for own in categories])
    chosen = F.get(lists, F.floor(drawn * len(categories)).cast("int"))
    described = cut.select(
        F.lit("$set").alias("event"),
        F.lit("item").alias("entity_type"),
        F.col("_part")[1].alias("entity_id"),
        F.lit(None).cast("string").alias("target_entity_type"),
        F.lit(None).cast("string").alias("target_entity_id"),
        F.create_map(F.lit("category"), chosen).alias("properties"),
        "seq",
    )
    return usage.unionByName(described)
