"""Rankings of items: popular, trending, hot, random, user-defined."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likewise.functions.hashing import uniform
from likewise.functions.times import duration, instant, instant_literal, whole_ms
from likewise.operators.events import events_between
from likewise.operators.stretches import Measure, StretchCounts
from likewise.params import Ranking


def _targets(events: DataFrame, start: datetime, end: datetime, names: Sequence[str]) -> DataFrame:
    return events_between(events, start, end, names).select(
        F.col("target_entity_id").alias("item"), "event_time"
    ).where(F.col("item").isNotNull())


def _count_between(
    events: DataFrame, lower: datetime, upper: datetime, also: Column | None = None
) -> Column:
    kind = events.schema["event_time"].dataType
    at = F.col("event_time")
    inside = (at >= instant_literal(lower, kind)) & (at < instant_literal(upper, kind))
    return F.count(F.when(inside if also is None else also & inside, F.lit(1)))


def _parts(start: datetime, end: datetime, n: int) -> list[datetime]:
    """Bounds of n stretches of whole milliseconds; the last takes the remainder."""
    step = timedelta(milliseconds=whole_ms(end - start) // n)
    return [start + i * step for i in range(n)] + [end]


def rank_popular(
    events: DataFrame, names: Sequence[str], start: datetime, end: datetime
) -> DataFrame:
    """Number of named events per target in the window, repeats counted."""
    seen = _targets(events, start, end, names)
    return seen.groupBy("item").agg(F.count("*").cast("double").alias("rank"))


def rank_trending(
    events: DataFrame, names: Sequence[str], start: datetime, end: datetime
) -> DataFrame:
    """Events in the newer half minus the older half, for targets seen in both.

    One scan with a conditional count per half stands in for counting each half and
    joining the two.
    """
    lo, mid, hi = _parts(start, end, 2)
    counted = _targets(events, start, end, names).groupBy("item").agg(
        _count_between(events, lo, mid).alias("older"),
        _count_between(events, mid, hi).alias("newer"),
    )
    return counted.where("older > 0 AND newer > 0").select(
        "item", (F.col("newer") - F.col("older")).cast("double").alias("rank")
    )


def rank_hot(
    events: DataFrame, names: Sequence[str], start: datetime, end: datetime
) -> DataFrame:
    """Change of the trend over three thirds, for targets seen in all three."""
    a, b, c, d = _parts(start, end, 3)
    counted = _targets(events, start, end, names).groupBy("item").agg(
        _count_between(events, a, b).alias("old"),
        _count_between(events, b, c).alias("mid"),
        _count_between(events, c, d).alias("new"),
    )
    acceleration = (F.col("new") - F.col("mid")) - (F.col("mid") - F.col("old"))
    return counted.where("old > 0 AND mid > 0 AND new > 0").select(
        "item", acceleration.cast("double").alias("rank")
    )


def rank_random(
    events: DataFrame, props: DataFrame, start: datetime, end: datetime, seed: int = 0
) -> DataFrame:
    """A fixed random number for every item seen in the window or having properties."""
    items = _targets(events, start, end, ()).select("item").union(props.select("item"))
    return items.distinct().select("item", uniform(seed, F.col("item")).alias("rank"))


def rank_user_defined(props: DataFrame, name: str) -> DataFrame:
    """The ranking given as an item property of that name."""
    value = F.get(F.col("props")[name], F.lit(0)).try_cast("double")
    return props.select("item", value.alias("rank")).where(F.col("rank").isNotNull())


def _session_now() -> datetime:
    """The current moment on the session's clock, in whose zone event times are read."""
    session = SparkSession.active()
    return session.range(1).select(F.current_timestamp().cast("timestamp_ntz")).first()[0]


def _window(ranking: Ranking, end: datetime | str | None) -> tuple[datetime, datetime]:
    close = instant(ranking.end or end or _session_now())
    return close - duration(ranking.duration), close


#: Into how many stretches a ranking cuts its window; random only asks who is in it.
_STRETCHES = {"popular": 1, "trending": 2, "hot": 3, "random": 1}


def _measures(ranking: Ranking, window: tuple[datetime, datetime]) -> list[Measure]:
    """A count per stretch of the ranking's window."""
    bounds = _parts(*window, _STRETCHES[ranking.type])
    names = ranking.event_names if ranking.type != "random" and ranking.event_names else None
    return [
        Measure(f"{ranking.column}:{i}", names, lo, hi)
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))
    ]


def _counts(events: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """(item, a column per measure), from one scan of the log between the ends of all windows."""
    anything = not all(m.names for m in measures)
    names = sorted({n for m in measures for n in m.names or ()})
    seen = events_between(
        events, min(m.lo for m in measures), max(m.hi for m in measures), () if anything else names
    ).where(F.col("target_entity_id").isNotNull())
    columns = []
    for m in measures:
        named = F.col("event").isin(list(m.names)) if m.names else F.lit(True)
        columns.append(_count_between(events, m.lo, m.hi, named).alias(m.column))
    return seen.groupBy(F.col("target_entity_id").alias("item")).agg(*columns)


def _value(ranking: Ranking, seed: int) -> Column:
    """The ranking from its counts, NULL for items it does not rank."""
    n = [F.col(f"`{ranking.column}:{i}`") for i in range(_STRETCHES.get(ranking.type, 0))]
    if ranking.type == "userDefined":
        return F.get(F.col("props")[ranking.column], F.lit(0)).try_cast("double")
    if ranking.type == "random":
        known = (F.coalesce(n[0], F.lit(0)) > 0) | F.col("props").isNotNull()
        return F.when(known, uniform(seed, F.col("item")))
    present = reduce(lambda x, y: x & y, [c > 0 for c in n])
    worth = {1: lambda a: a, 2: lambda a, b: b - a, 3: lambda a, b, c: (c - b) - (b - a)}
    return F.when(present, worth[len(n)](*n).cast("double"))


def rank_table(
    rankings: Sequence[Ranking],
    events: DataFrame,
    props: DataFrame,
    end: datetime | str | None = None,
    seed: int = 0,
    catalog_only: bool = False,
    stored: StretchCounts | None = None,
) -> DataFrame:
    """One row per ranked item, one column per ranking; ``end`` closes open windows.

    All rankings share one scan of the log and one shuffle: every stretch of every
    window is a conditional count of the same aggregation. With ``stored`` counts only the
    edges of the windows are read from the log. One full outer join adds
    what comes from properties. ``catalog_only`` leaves out targets without properties.
    """
    counted_ones = [r for r in rankings if r.type in _STRETCHES]
    measures = [m for r in counted_ones for m in _measures(r, _window(r, end))]
    ranked = props
    if measures:
        counts = stored.counts(events, measures) if stored else _counts(events, measures)
        ranked = props.join(counts, "item", "full_outer")
    if catalog_only:
        ranked = ranked.where(F.col("props").isNotNull())
    columns = [r.column for r in rankings]
    table = ranked.select("item", *[_value(r, seed).alias(r.column) for r in rankings])
    return table.where(F.coalesce(*columns).isNotNull())
