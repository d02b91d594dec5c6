"""Usage laid out by user, for reading the histories of a few users out of many.

Rows lie in buckets by a hash of the user, sorted by user and time, with Bloom filters of the users in
every file: the users of a batch of queries are looked for in their buckets only, and in these
only where they may be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from likewise.sources.tables import usage_events

#: Buckets of a history, and files that a bucket's rows are dealt to, so no user is one task.
BUCKETS, FILES = 256, 4

#: Users up to which their ids reach the scan, where Bloom filters are asked for them.
FEW = 200


@dataclass(frozen=True)
class History:
    """A history in a folder: rows of (user, event, item, event_time) by bucket."""

    spark: SparkSession
    path: str

    def _info(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/info")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def user_type(self) -> DataType:
        return self.rows().schema["user"].dataType

    def event_names(self) -> set[str]:
        """The event types that the history holds; one row of each per append."""
        return {r["event"] for r in self._info().select("event").distinct().collect()}

    def of(self, users: DataFrame, names: list[str]) -> DataFrame:
        """(user, event, item, event_time) of these users and event types.

        ``users`` has a column ``user``. The driver receives the numbers of the buckets asked for, at
        most as many as there are, and the users themselves if they are at most ``FEW``.
        """
        n_buckets = self._info().first()["n_buckets"]
        asked = users.where("user IS NOT NULL").distinct().withColumn("bucket", _bucket(n_buckets))
        numbers = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())
        rows = self.rows().where(F.col("bucket").isin(numbers) & F.col("event").isin(list(names)))
        few = [r["user"] for r in asked.select("user").limit(FEW + 1).collect()]
        if len(few) <= FEW:
            rows = rows.where(F.col("user").isin(few))
        else:
            rows = rows.join(asked, ["bucket", "user"], "left_semi")
        return rows.select("user", "event", "item", "event_time")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("user"), F.lit(n)).cast("int")


def write_history(
    events: DataFrame, names: list[str], path: str, buckets: int = BUCKETS, append: bool = False
) -> History:
    """Lay out the usage events of these names; with ``append`` beside what is there already.

    All appends of a history have the same number of buckets.
    """
    spark = events.sparkSession
    usage = usage_events(events, names).withColumn("bucket", _bucket(buckets))
    mode = "append" if append else "overwrite"
    dealt = usage.repartition("bucket", F.pmod(F.xxhash64("item", "event_time"), F.lit(FILES)))
    (
        dealt.sortWithinPartitions("bucket", "user", "event_time")
        .write.mode(mode)
        .option("parquet.bloom.filter.enabled#user", "true")
        .partitionBy("bucket")
        .parquet(f"{path}/rows")
    )
    found = usage.groupBy("event").agg(F.count("*").alias("n")).withColumn("n_buckets", F.lit(buckets))
    found.coalesce(1).write.mode(mode).parquet(f"{path}/info")
    return History(spark, path)
