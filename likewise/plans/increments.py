"""Correlators kept up to date by changes of the log.

Counts of pairs, of users per target and of users are sums, so a batch of new and removed events adds
to them what it changes: of the users it touches the acts that appear or vanish meet all acts of the same
user, old and new. No pair of two acts that stay is counted again, and no other user's acts are
looked at. What the sums come to is what counting the whole log would give.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likewise.operators.similarity import llr_of, llr_threshold, top_correlators
from likewise.params import Indicator
from likewise.sources.staging import stage
from likewise.sources.store import folder_of

_ACT = ["user", "event", "item"]
_PAIR = ["item", "event", "correlator"]
_KEPT, _NEW, _GONE = "kept", "new", "gone"


@dataclass(frozen=True)
class PairCounts:
    """Signed counts by batch in a folder that all executors share.

    Indicators with caps on a user's or an item's events are refused: which events are cut
    depends on all others.
    """

    spark: SparkSession
    folder: str
    indicators: Sequence[Indicator]
    min_events: int | None = None

    def __post_init__(self) -> None:
        if any(i.max_items_per_user is not None for i in self.indicators):
            raise ValueError("caps on events per user or item cannot be kept up to date")

    @property
    def primary(self) -> str:
        return self.indicators[0].name

    def committed(self) -> list[int]:
        """The batches whose last write has left its marker."""
        system, path = folder_of(self.spark, f"{self.folder}/users/batch=*/_SUCCESS")
        found = system.globStatus(path)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def _read(self, table: str, batches: Sequence[int]) -> DataFrame:
        paths = [f"{self.folder}/{table}/batch={b}" for b in batches]
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*paths).drop("batch")

    def _acts(self, users: DataFrame, batches: Sequence[int], like: DataFrame) -> DataFrame:
        """(user, event, item, n): the raw events of these users so far."""
        if not batches:
            return like.limit(0)
        return self._read("acts", batches).join(users, "user", "left_semi").select(*_ACT, "n")

    def _active(self, acts: DataFrame) -> DataFrame:
        enough = acts.where(F.col("event") == self.primary).groupBy("user").agg(F.sum("n").alias("n"))
        return enough.where(F.col("n") >= (self.min_events or 1)).select("user")

    def _tagged(self, delta: DataFrame, batches: Sequence[int]) -> tuple[DataFrame, DataFrame]:
        """The touched users' acts with what becomes of each, and the change of the number of users."""
        users = delta.select("user").distinct()
        old = self._acts(users, batches, delta).groupBy(*_ACT).agg(F.sum("n").alias("before"))
        both = (
            old.withColumn("change", F.lit(0).cast("bigint"))
            .unionByName(delta.select(*_ACT, F.lit(0).cast("bigint").alias("before"), F.col("n").alias("change")))
            .groupBy(*_ACT)
            .agg(F.sum("before").alias("before"), (F.sum("before") + F.sum("change")).alias("after"))
        )
        both = stage(both, "touched-acts")
        was = self._active(both.where("before > 0").select(*_ACT, F.col("before").alias("n")))
        is_ = self._active(both.where("after > 0").select(*_ACT, F.col("after").alias("n")))
        active = was.withColumn("was", F.lit(1)).join(is_.withColumn("is", F.lit(1)), "user", "full_outer")
        active = stage(active.select("user", F.col("was").isNotNull().alias("was"), F.col("is").isNotNull().alias("is")), "active")
        had, has = F.col("was") & (F.col("before") > 0), F.col("is") & (F.col("after") > 0)
        fate = F.when(had & has, _KEPT).when(has, _NEW).when(had, _GONE)
        acts = both.join(active, "user").select(*_ACT, fate.alias("fate")).where("fate IS NOT NULL")
        moved = active.agg((F.count(F.when(F.col("is"), 1)) - F.count(F.when(F.col("was"), 1))).alias("n"))
        return acts, moved

    def _pairs(self, acts: DataFrame) -> DataFrame:
        """(item, event, correlator, n): by how much the pairs' counts change."""
        own = acts.where(F.col("event") == self.primary).select("user", "item", "fate")
        other = acts.select("user", "event", F.col("item").alias("correlator"), F.col("fate").alias("other"))
        kept = F.col("fate") == _KEPT
        changed = own.where(~kept).join(other, "user").unionByName(
            own.where(kept).join(other.where(F.col("other") != _KEPT), "user")
        )
        fates = F.array_distinct(F.array("fate", "other"))
        apart = (F.col("event") != self.primary) | (F.col("item") != F.col("correlator"))
        sign = F.when(F.array_contains(fates, _NEW), 1).otherwise(-1)
        together = ~(F.array_contains(fates, _NEW) & F.array_contains(fates, _GONE))
        counted = changed.where(apart & together).groupBy(*_PAIR).agg(F.sum(sign).alias("n"))
        return counted.where("n != 0")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit a batch of (user, event, item, n), n events more or, negative, fewer.

        False if it was committed before and nothing is done. Removing more events than there
        are leaves less than none; they have to be added back before the act counts again.
        """
        before = self.committed()
        if batch in before:
            return False
        names = [i.name for i in self.indicators]
        delta = changes.where(F.col("event").isin(names)).groupBy(*_ACT).agg(F.sum("n").cast("bigint").alias("n"))
        delta = stage(delta.where("n != 0"), "delta")
        acts, moved = self._tagged(delta, before)
        acts = stage(acts, "fates")
        change = F.when(F.col("fate") == _NEW, 1).when(F.col("fate") == _GONE, -1).otherwise(0)
        margins = acts.groupBy("event", "item").agg(F.sum(change).alias("n")).where("n != 0")

        # the users last: its marker is what commits
        tables = {"acts": delta.select(*_ACT, "n"), "margins": margins, "pairs": self._pairs(acts), "users": moved}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        return True

    def counts(self) -> DataFrame:
        """(item, event, correlator, n_both, n_item, n_correlator) of all committed batches."""
        batches = self.committed()
        pairs = self._read("pairs", batches).groupBy(*_PAIR).agg(F.sum("n").alias("n_both")).where("n_both > 0")
        margins = self._read("margins", batches).groupBy("event", "item").agg(F.sum("n").alias("n"))
        margins = stage(margins.where("n > 0"), "margins")
        own = margins.where(F.col("event") == self.primary).select("item", F.col("n").alias("n_item"))
        other = margins.select("event", F.col("item").alias("correlator"), F.col("n").alias("n_correlator"))
        return pairs.join(own, "item").join(other, ["event", "correlator"]).select(
            *_PAIR, "n_both", "n_item", "n_correlator"
        )

    def correlators(self) -> DataFrame:
        """(item, event, correlator, llr, rnk), as from the whole log."""
        n_users = self._read("users", self.committed()).agg(F.sum("n")).scalar()
        scored = llr_of(self.counts(), n_users)
        return llr_threshold(top_correlators(scored, self.indicators), self.indicators)

