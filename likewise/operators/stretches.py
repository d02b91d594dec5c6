"""Events counted once per item and stretch of time, for rankings over any window.

A closed stretch's counts are written and never made again. A window is the sum of the whole
stretches inside it, and of the events of its two edges, which alone are read from the log.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likewise.functions.times import instant_literal
from likewise.operators.events import events_between
from likewise.sources.store import folder_of

_ORIGIN = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Measure:
    """Events of these names (any, if None) with ``lo <= event_time < hi``, as a column."""

    column: str
    names: tuple[str, ...] | None
    lo: datetime
    hi: datetime


@dataclass(frozen=True)
class StretchCounts:
    """Counts in a folder that all executors share; ``seconds`` is the length of a stretch.

    Stretches follow the session's clock. Events that arrive after their stretch is counted are
    not seen any more, so update up to a moment before which the log is complete.
    """

    spark: SparkSession
    folder: str
    seconds: int = 3600

    def _floor(self, moment: datetime) -> int:
        return (moment - _ORIGIN) // timedelta(seconds=self.seconds)

    def _start(self, stretch: int) -> datetime:
        return _ORIGIN + timedelta(seconds=stretch * self.seconds)

    def _ranges(self) -> list[tuple[int, int]]:
        """The ranges of stretches whose last write has left its marker, in order."""
        system, path = folder_of(self.spark, f"{self.folder}/stretches=*/_SUCCESS")
        names = [f.getPath().getParent().getName() for f in system.globStatus(path) or []]
        return sorted(tuple(map(int, n.split("=")[1].split("_"))) for n in names)

    def covered(self) -> tuple[datetime, datetime] | None:
        """From when to when events are counted."""
        known = self._ranges()
        return (self._start(known[0][0]), self._start(known[-1][1])) if known else None

    def update(self, events: DataFrame, upto: datetime, since: datetime | None = None) -> None:
        """Count the stretches that have closed by ``upto``; only these are read.

        The first time they begin with ``since``, or else with the oldest event.
        """
        known = self._ranges()
        if known:
            lo = known[-1][1]
        else:
            first = since or events.agg(F.min("event_time").cast("timestamp_ntz").alias("t")).first()["t"]
            if first is None:
                return
            lo = self._floor(first)
        hi = self._floor(upto)
        if hi <= lo:
            return
        seen = events_between(events, self._start(lo), self._start(hi))
        counted = (
            seen.where(F.col("target_entity_id").isNotNull())
            .groupBy(F.col("target_entity_id").alias("item"), "event", self._stretch().alias("stretch"))
            .agg(F.count("*").alias("n"))
        )
        counted.write.mode("overwrite").parquet(f"{self.folder}/stretches={lo}_{hi}")

    def _stretch(self) -> Column:
        """The number of the stretch that an event lies in, by the session's clock."""
        at = F.col("event_time").cast("timestamp_ntz")
        days = F.date_diff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
        seconds = days * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
        return F.floor(seconds / self.seconds).cast("bigint")

    def _edges(self, m: Measure) -> tuple[int, int]:
        """The whole stretches of a measure's window that are counted: from, to."""
        known = self._ranges()
        lo, hi = -self._floor(_ORIGIN - (m.lo - _ORIGIN)), self._floor(m.hi)
        if known:
            lo, hi = max(lo, known[0][0]), min(hi, known[-1][1])
        if not known or lo >= hi:
            return 0, 0
        return lo, hi

    def counts(self, events: DataFrame, measures: Sequence[Measure]) -> DataFrame:
        """(item, one column per measure): the same as counting the events of the windows."""
        kind = events.schema["event_time"].dataType
        at = F.col("event_time")

        def between(lo: datetime, hi: datetime) -> Column:
            return (at >= instant_literal(lo, kind)) & (at < instant_literal(hi, kind))

        edges, sums = F.lit(False), []
        for m in measures:
            lo, hi = self._edges(m)
            if lo < hi:
                edge = between(m.lo, self._start(lo)) | between(self._start(hi), m.hi)
            else:
                edge = between(m.lo, m.hi)
            named = F.col("event").isin(list(m.names)) if m.names else F.lit(True)
            whole = (F.col("stretch") >= lo) & (F.col("stretch") < hi)
            edges = edges | (edge & named)
            counts = F.when(named & F.coalesce(F.when(at.isNotNull(), edge).otherwise(whole), F.lit(False)), F.col("n"))
            sums.append(F.coalesce(F.sum(counts), F.lit(0)).alias(m.column))
        seen = events.where(edges & F.col("target_entity_id").isNotNull()).select(
            F.col("target_entity_id").alias("item"),
            "event",
            F.lit(None).cast("bigint").alias("stretch"),
            F.lit(1).cast("bigint").alias("n"),
            "event_time",
        )
        paths = [f"{self.folder}/stretches={a}_{b}" for a, b in self._ranges()]
        if paths:
            none = F.lit(None).cast(kind).alias("event_time")
            used = [self._edges(m) for m in measures]
            inside = (F.col("stretch") >= min(a for a, _ in used)) & (F.col("stretch") < max(b for _, b in used))
            stored = self.spark.read.parquet(*paths).where(inside)
            seen = seen.unionByName(stored.select("item", "event", "stretch", "n", none))
        return seen.groupBy("item").agg(*sums)
