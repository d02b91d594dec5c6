"""Published models: complete versions side by side, readers switched in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likewise.operators.model import Model

TABLES = ("correlators", "items", "postings", "weights")


def folder_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as that system takes it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first. A version counts once its marker is written."""
    system, place = folder_of(spark, f"{path}/published")
    if not system.exists(place):
        return []
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def publish(model: Model, path: str, keep: int = 2, max_write_tasks: int | None = None) -> int:
    """Write the whole model beside the current one, then switch readers to it.

    The switch is the creation of one marker file, so a reader sees the old version or
    the complete new one. Older versions beyond ``keep`` go only after the switch; the one
    before the new version stays by default, for readers that still use it.
    ``max_write_tasks`` limits the number of concurrent writers of each table.
    """
    spark = model.items.sparkSession
    known = versions(spark, path)
    version = known[-1] + 1 if known else 1
    for name, table in model.tables().items():
        if max_write_tasks:
            table = table.coalesce(max_write_tasks)
        table.write.mode("overwrite").parquet(f"{path}/v={version}/{name}")
    system, marker = folder_of(spark, f"{path}/published/v={version}")
    system.create(marker).close()
    for old in known[: len(known) + 1 - keep]:
        system.delete(folder_of(spark, f"{path}/published/v={old}")[1], False)
        system.delete(folder_of(spark, f"{path}/v={old}")[1], True)
    return version


def load(spark: SparkSession, path: str) -> Model | None:
    """The current version, or None where nothing is published."""
    known = versions(spark, path)
    if not known:
        return None
    base = f"{path}/v={known[-1]}"
    tables = {name: spark.read.parquet(f"{base}/{name}") for name in TABLES}
    system, bitmaps = folder_of(spark, f"{base}/bitmaps")
    if system.exists(bitmaps):
        tables["bitmaps"] = spark.read.parquet(f"{base}/bitmaps")
    return Model(**tables)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(item, props) of the current version; no rows where nothing is published."""
    model = load(spark, path)
    if model is None:
        return spark.createDataFrame([], "item string, props map<string,array<string>>")
    return model.documents()


def lookup_items(queries: DataFrame, model: Model) -> DataFrame:
    """(query_id, item, props) of the items asked for; ``props`` is NULL for unknown ones."""
    asked = queries.select("query_id", "item").where(F.col("item").isNotNull())
    found = model.documents(only=asked.select("item").distinct())
    return asked.join(found, "item", "left").select("query_id", "item", "props")
