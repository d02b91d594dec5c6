"""Per-group selection that stays spread out when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likewise.sources.staging import stage

#: Into how many shards a group may be split before its final selection.
SHARDS = 64

#: Up to this k Spark drops surplus rows of a group before the shuffle
#: (the default of spark.sql.optimizer.windowGroupLimitThreshold).
PRE_SHUFFLE_LIMIT = 1000


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by the keys over ``spark.sql.shuffle.partitions`` tasks, however small they are.

    For rows about to grow (into a row per property, per place of a list) and to be sorted then.
    The number of tasks is fixed: a small file is a single task of its scan, and adaptive execution
    would merge tasks by their size before they grow.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys)


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rnk",
    shards: int | None = None,
) -> DataFrame:
    """The first ``k`` rows of every group, numbered from 1 in column ``rank``.

    With one shard, rows go to their group's task in one shuffle. Spark applies the
    window group limit before it (for ``k`` up to 1000), so even a group holding a third
    of all rows arrives as at most ``k`` rows per upstream partition.

    With several, rows are first cut to ``k`` inside (group, shard), where the shard is
    the upstream partition they come from, then the at most ``shards * k`` survivors
    of a group meet. That serves a larger ``k``, and input that is already partitioned
    on a subset of ``keys`` (after a join): the shard key is one struct on purpose, as
    plain columns would let Spark reuse that partitioning and leave a hot group in the
    one task that already holds it.

    By default ``k`` decides between the two.
    """
    if shards is None:
        shards = 1 if k <= PRE_SHUFFLE_LIMIT else SHARDS
    keys, order = list(keys), list(order)
    if shards > 1:
        shard = F.spark_partition_id() % shards
        inner = Window.partitionBy("_shard").orderBy(*order)
        df = (
            df.withColumn("_shard", F.struct(shard.alias("part"), *keys))
            .withColumn("_rnk", F.row_number().over(inner))
            .where(F.col("_rnk") <= k)
            .drop("_shard", "_rnk")
        )
    outer = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= k)


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Number all rows from 1 in the given total order without a single-task sort.

    Range partitioning sorts the table in parallel; a row's number is its place in
    its partition plus the sizes of the partitions before it. The sorted table is
    staged once so that both uses see the very same partitions.
    """
    order = list(order)
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = stage(
        placed.withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id"),
        "numbered",
    )
    # one row per partition: a few thousand at most, whatever the table's size
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return placed.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_start") + F.col("_row") + 1).alias(name)
    )
