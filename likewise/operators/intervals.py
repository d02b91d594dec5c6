"""Moments between the dates of items.

The sorted dates of all items cut time into pieces inside which no rule about these dates can change
its verdict on any item. Moments are moved to the ends of their pieces, so that however many
different ones are asked about, there are no more than the dates tell apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likewise.operators.groups import number_rows
from likewise.operators.querying import rule_text
from likewise.params import EngineParams
from likewise.sources.staging import stage

#: Kind of the moments that are held against the dates of availability and expiry.
_NOW = ""

#: Before every date that an item has.
EARLIEST = "0001-01-01T00:00:00"


def item_dates(items: DataFrame, params: EngineParams) -> DataFrame:
    """(kind, date): the dates of items by name, and those of availability and expiry together."""
    pairs = [F.struct(F.lit(d).alias("kind"), F.col(d).alias("date")) for d in params.date_columns]
    window = (params.available_date_name, params.expire_date_name)
    if all(window):
        pairs += [F.struct(F.lit(_NOW).alias("kind"), F.col(d).alias("date")) for d in window]
    return items.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("date IS NOT NULL")


def pieces(moments: DataFrame, dates: DataFrame) -> DataFrame:
    """(kind, moment, floor, ceil): the last date up to every moment and the first one from it on.

    Both tables are sorted together, in parallel by ranges; what a range's first moments look back
    to, and its last ones forward, comes from one row per range and kind.
    """
    known = dates.distinct().select("kind", F.col("date").alias("t"), F.col("date"))
    asked = moments.distinct().select("kind", F.col("moment").alias("t"), F.lit(None).cast("timestamp").alias("date"))
    placed = known.unionByName(asked.where("t IS NOT NULL")).repartitionByRange("kind", "t")
    placed = stage(placed.withColumn("_part", F.spark_partition_id()), "pieces")
    # frames reach from the first row to all rows with the same moment
    inside = Window.partitionBy("_part", "kind")
    found = placed.withColumn("floor", F.max("date").over(inside.orderBy("t"))).withColumn(
        "ceil", F.min("date").over(inside.orderBy(F.col("t").desc()))
    )
    ends = placed.groupBy("_part", "kind").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    row = Window.partitionBy("kind").orderBy("_part")
    carried = ends.select(
        F.col("_part"),
        F.col("kind"),
        F.max("hi").over(row.rowsBetween(Window.unboundedPreceding, -1)).alias("behind"),
        F.min("lo").over(row.rowsBetween(1, Window.unboundedFollowing)).alias("ahead"),
    )
    return (
        found.where("date IS NULL")
        # a row per range and kind: a few thousand at most, whatever the tables' size
        .join(F.broadcast(carried), ["_part", "kind"])
        .select(
            "kind",
            F.col("t").alias("moment"),
            F.coalesce("floor", "behind").alias("floor"),
            F.coalesce("ceil", "ahead").alias("ceil"),
        )
    )


def share_moments(asked: DataFrame, items: DataFrame, params: EngineParams) -> DataFrame:
    """Queries with their dates moved to the ends of their pieces; what they may return stays.

    An item is available at a moment if it is at the last date before it, is later than a date
    if it is later than the last one up to it, and earlier if it is earlier than the first one from
    it on. Bounds beyond all dates fall away.
    """
    if not params.date_columns:
        return asked
    own = {"now": F.lit(_NOW), "after": F.col("date_name"), "before": F.col("date_name")}
    given = [F.struct(kind.alias("kind"), F.col(c).alias("moment")) for c, kind in own.items()]
    moments = asked.select(F.explode(F.array(*given)).alias("m")).select("m.*").where("moment IS NOT NULL")
    if moments.isEmpty():
        return asked
    ends = stage(pieces(moments, item_dates(items, params)), "ends")
    columns = asked.columns
    for name, kind in own.items():
        end = "ceil" if name == "before" else "floor"
        mine = ends.select(
            F.col("kind").alias("_kind"), F.col("moment").alias("_moment"), F.col(end).alias("_end")
        )
        asked = asked.join(mine, (F.col(name) == F.col("_moment")) & (kind == F.col("_kind")), "left")
        moved: Column = F.col("_end")
        if name == "now":
            moved = F.when(F.col(name).isNotNull(), F.coalesce(moved, F.lit(EARLIEST).cast("timestamp")))
        asked = asked.withColumn(name, moved).select(*columns)
    return asked.withColumn("rules", rule_text(F.col("rules").isNotNull()))


def date_index(items: DataFrame, name: str) -> DataFrame:
    """(idx, date, pos): the items that have this date, numbered in its order."""
    dated = items.select(F.col(name).alias("date"), "pos").where("date IS NOT NULL")
    return number_rows(dated, [F.col("date"), F.col("pos")], "idx")
