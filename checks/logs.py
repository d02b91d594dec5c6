"""The test tables seen as event logs.

events        a usage log: user_id does event_type to item k (from props)
part          the catalog: one $set event per part with its properties and dates
events again  a property log: signup sets, error unsets or deletes a property of item k
orders and    a larger usage log with bigint ids: a customer's parts, the return flag
lineitem      being the event type
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which ranking windows close and availability is judged.
NOW = "2024-01-31T00:00:00"

USAGE = ["purchase", "view", "click"]
FLAGS = ["N", "R", "A"]

_PROPS = "map<string,array<string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_usage(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("event"),
        F.lit("user").alias("entity_type"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.lit("item").alias("target_entity_type"),
        F.get_json_object("props", "$.k").alias("target_entity_id"),
        F.lit(None).cast(_PROPS).alias("properties"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("seq"),
    )


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_usage(table(spark, sf_dir, "events"))


def property_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup is $set, error is $unset, or $delete where its value exceeds 150."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error"))
    name = F.concat(F.lit("h"), F.floor(F.hour("ts") / 6).cast("string"))
    op = (
        F.when(F.col("event_type") == "signup", "$set")
        .when(F.col("value") > 150, "$delete")
        .otherwise("$unset")
    )
    values = F.when(
        F.col("event_type") == "signup", F.array(F.col("user_id").cast("string"))
    ).otherwise(F.array().cast("array<string>"))
    return events.select(
        op.alias("event"),
        F.lit("item").alias("entity_type"),
        F.get_json_object("props", "$.k").alias("entity_id"),
        F.lit(None).cast("string").alias("target_entity_type"),
        F.lit(None).cast("string").alias("target_entity_id"),
        F.when(op != "$delete", F.create_map(name, values)).alias("properties"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("seq"),
    )


def catalog_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available from p_size days after 2023-12-15, for 40 days."""
    opens = F.date_add(F.lit("2023-12-15").cast("date"), F.col("p_size"))

    def day(date):
        return F.array(F.concat(date.cast("string"), F.lit("T00:00:00")))

    price = F.array(F.col("p_retailprice").cast("string"))
    props = F.create_map(
        F.lit("brand"), F.array("p_brand"),
        F.lit("tags"), F.array("p_brand", "p_type"),
        F.lit("size"), F.array(F.col("p_size").cast("string")),
        F.lit("price"), price,
        F.lit("userRank"), price,
        F.lit("big"), F.array((F.col("p_size") > 25).cast("string")),
        F.lit("date"), day(opens),
        F.lit("available"), day(opens),
        F.lit("expires"), day(F.date_add(opens, 40)),
    )
    return table(spark, sf_dir, "part").select(
        F.lit("$set").alias("event"),
        F.lit("item").alias("entity_type"),
        F.col("p_partkey").cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("target_entity_type"),
        F.lit(None).cast("string").alias("target_entity_id"),
        props.alias("properties"),
        F.lit("2024-01-01T00:00:00").cast("timestamp_ntz").alias("event_time"),
        F.lit(-1).cast("bigint").alias("seq"),
    )


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_log(spark, sf_dir).unionByName(catalog_log(spark, sf_dir))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_returnflag").alias("event"),
        F.lit("user").alias("entity_type"),
        F.col("o_custkey").alias("entity_id"),
        F.lit("item").alias("target_entity_type"),
        F.col("l_partkey").alias("target_entity_id"),
        F.lit(None).cast(_PROPS).alias("properties"),
        F.col("o_orderdate").alias("event_time"),
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def interactions(log: DataFrame) -> DataFrame:
    return log.select(
        F.col("entity_id").alias("user"), "event", F.col("target_entity_id").alias("item")
    )


def catalog_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, props) straight from the catalog, for operators after the folding."""
    return catalog_log(spark, sf_dir).select(
        F.col("entity_id").alias("item"), F.col("properties").alias("props")
    )
