"""The event log as a stream: popularity per time window, and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from likewise.operators.events import LOG_KEY, properties_text


def read_event_stream(
    spark: SparkSession, path: str, schema: StructType, file_name: str = "*.parquet"
) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.format("parquet").schema(schema)
    return reader.option("pathGlobFilter", file_name).load(path)


def stream_popularity(
    events: DataFrame, names: Sequence[str], window: str, lateness: str
) -> DataFrame:
    """(start, item, rank): events per target and window; open windows can still change.

    State is one counter per open window and item; counts combine before the shuffle.
    """
    return (
        events.where(F.col("event").isin(list(names)) & F.col("target_entity_id").isNotNull())
        .withColumn("event_time", F.col("event_time").cast("timestamp"))
        .withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", window).alias("w"), F.col("target_entity_id").alias("item"))
        .agg(F.count("*").cast("double").alias("rank"))
        .select(F.col("w.start").alias("start"), "item", "rank")
    )


def stream_dedup_events(events: DataFrame, lateness: str) -> DataFrame:
    """Each identical event once, remembered for ``lateness`` of event time."""
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp"))
    keyed = timed.withColumn("_properties", properties_text()).withWatermark("event_time", lateness)
    return keyed.dropDuplicatesWithinWatermark([*LOG_KEY, "_properties"]).drop("_properties")


def run_to_latest(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Process everything available; the latest row of every key, open windows included.

    Each micro-batch writes the rows it has changed to a folder of its own, replacing what a
    lost attempt left there. A later run with the same folders goes on where this one ended.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .foreachBatch(commit)
        .start()
    )
    query.awaitTermination()
    written = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    rows = stream.sparkSession.read.schema(written).option("basePath", path).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*[F.col("_last")[c].alias(c) if c in rest else F.col(c) for c in stream.columns])


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available, append it to a Parquet table, and read that."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
