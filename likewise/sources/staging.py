"""Intermediate tables in the cluster's shared folder.

A staged table replaces a checkpoint: it cuts the lineage, survives the loss of any
executor, and, being Parquet, keeps column pruning and a real size on which Spark
decides about broadcasting. All tables of an application lie in one folder, which is
removed when the application's JVM ends. Tables that were only needed on the way to another
one go earlier, and so do the shuffle files of what was written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes the shuffle files of a query with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of the tables staged on the way to the one that is being made.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A session with neither uses its warehouse, which executors share as well.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's folder of staged tables, removed when its JVM ends."""
    folder = f"{shared_folder(spark)}/likewise/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files behind.

    Otherwise these stay until the driver's JVM happens to collect the query.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _staged(df: DataFrame, path: str, **options: str) -> DataFrame:
    spark = df.sparkSession
    with passing_shuffles(spark):
        df.write.mode("append").parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def _remember(path: str) -> None:
    passing = _passing.get()
    if passing is not None:
        passing.append(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the table once and continue from the written copy."""
    path = staged_path(df.sparkSession, name)
    _remember(path)
    return _staged(df, path)


def stage_parts(spark: SparkSession, parts: Sequence[Callable[[], DataFrame]], name: str) -> DataFrame:
    """One staged table of parts with the same columns, each made and written after the one before.

    Tables that are staged while a part is made go when it is written: nothing but the part may
    read them. So at any time the disk holds what is written and what one part needs.
    Such tables are large, and ids of many items take a third less with zstd.
    """
    path = staged_path(spark, name)
    _remember(path)
    for make in parts:
        passing: list[str] = []
        token = _passing.set(passing)
        try:
            table = _staged(make(), path, compression="zstd")
        finally:
            _passing.reset(token)
            remove(spark, passing)
    return table


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for each in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(each)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_slices(n: int, *keys: str | Column) -> list[Column]:
    """``n`` conditions, of which every row meets one: rows with the same keys the same."""
    if n <= 1:
        return [F.lit(True)]
    slot = F.pmod(F.xxhash64(F.lit("slice"), *keys), F.lit(n))
    return [slot == i for i in range(n)]
