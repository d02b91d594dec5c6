"""Exact duplicates found by a stream that keeps a disk-backed state without expiry.

Texts arrive as a stream of fingerprints: digest, document id and the place of the content
(its file and row). The state holds, for every digest seen so far, how
often it was seen, the id that stays and the place of that text, in RocksDB on the executors'
disks with its checkpoints in the shared folder; nothing ever expires. A digest that was seen
more than once is a hit, and only for hits the texts are fetched again and compared in full, so
that two texts that merely share a digest are never taken for one another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likewise.llm import text as tx
from likewise.sources.staging import stage, staged_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: How the state is kept while the stream runs. Without fallocate a small store takes what it
#: holds, and not several megabytes for each partition.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: What one micro-batch reads of the fingerprints (about 100 bytes a document).
BATCH_BYTES = 4 << 30


def placed(docs: DataFrame, place: str) -> DataFrame:
    """``docs`` and a column ``place``: the file and row that hold a row's content.

    A frame that isn't a plain scan of files is written to the shared folder first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = stage(docs, "exact-documents")
    source = docs.metadataColumn("_metadata")
    return docs.withColumn(place, F.struct(source["file_path"], source["row_index"]))


def _texts(rows: DataFrame, place: str) -> DataFrame:
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        tx.whole(F.col("text")).alias("text"),
        F.col(place).alias("place"),
    )


def run_state(
    spark: SparkSession, arrivals: str, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Feed a folder of fingerprints through the keyed state; its last word on every digest.

    Every micro-batch writes the digests it touched to a folder named by the batch, replacing
    what a lost attempt may have left, so a batch that is run again changes nothing.
    """
    updates, progress = staged_path(spark, "exact-updates"), staged_path(spark, "exact-state")
    schema = spark.read.parquet(arrivals).schema
    seen = (
        spark.readStream.schema(schema)
        .option("maxBytesPerTrigger", batch_bytes)
        .parquet(arrivals)
        .groupBy("digest")
        .agg(
            F.max(F.struct("doc_id", "place")).alias("stays"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={batch_id}")

    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        query = (
            seen.writeStream.outputMode("update")
            .option("checkpointLocation", progress)
            .trigger(availableNow=True)
            .foreachBatch(commit)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    kept = f"digest string, stays {seen.schema['stays'].dataType.simpleString()}, n_rows bigint"
    return (
        spark.read.schema(f"{kept}, batch int")
        .option("basePath", updates)
        .parquet(updates)
        .groupBy("digest")
        .agg(
            F.max_by("stays", "batch").alias("stays"),
            F.max("n_rows").alias("n_rows"),
        )
    )


def exact_groups(
    docs: DataFrame,
    digest: Callable[[Column], Column] = tx.digest,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, place, keep_id, group_size, kept.

    Of equal texts the row with the largest ``doc_id`` stays; a null id is smaller than any
    other. A null text is an empty one. Of rows that repeat the id that stays, the one whose
    place comes last is kept, so every group keeps exactly one row. An empty table gives an
    empty one. Other columns of ``docs`` are not looked at.
    """
    place = tx.unused(docs, "_place")
    return _groups(placed(docs, place), place, digest, batch_bytes)


def _groups(
    rows: DataFrame, place: str, digest: Callable[[Column], Column], batch_bytes: int
) -> DataFrame:
    spark, texts = rows.sparkSession, _texts(rows, place)
    arrivals = staged_path(spark, "exact-arrivals")
    texts.select("doc_id", "place", digest(F.col("text")).alias("digest")).write.parquet(arrivals)
    prints = spark.read.parquet(arrivals)
    state = stage(run_state(spark, arrivals, batch_bytes), "exact-seen")

    # Hits: every text whose digest came more than once meets the text that stays.
    hits = state.where("n_rows > 1").select("digest", "stays")
    met = stage(
        texts.withColumn("digest", digest(F.col("text"))).join(hits, "digest"), "exact-hits"
    )
    staying = met.where("place = stays.place").select(
        F.col("digest"), F.col("text").alias("kept_text")
    )
    differ = stage(
        met.join(staying, "digest").where("text != kept_text").select("digest", "place", "doc_id", "text"),
        "exact-collisions",
    )
    # Other texts under the same digest are groups of their own, keyed by the full text.
    apart = differ.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", "place")).alias("own_stays"), F.count(F.lit(1)).alias("own_rows")
    )
    apart = differ.join(apart, ["digest", "text"]).select("place", "own_stays", "own_rows")
    fewer = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("n_apart"))
    main = state.join(fewer, "digest", "left").select(
        "digest", "stays", (F.col("n_rows") - F.coalesce("n_apart", F.lit(0))).alias("n_rows")
    )
    stays = F.coalesce("own_stays", "stays")
    return (
        prints.join(main, "digest")
        .join(apart, "place", "left")
        .select(
            "doc_id",
            "digest",
            "place",
            stays["doc_id"].alias("keep_id"),
            F.coalesce("own_rows", "n_rows").alias("group_size"),
            (stays["place"] == F.col("place")).alias("kept"),
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns as they are.

    Null texts count as empty ones, rows without an id as those of the smallest id; of rows that
    repeat a text and an id one stays. Very long texts are compared whole. An empty table gives
    an empty one.
    """
    place = tx.unused(docs, "_place")
    rows = placed(docs, place)
    gone = _groups(rows, place, tx.digest, BATCH_BYTES).where(~F.col("kept"))
    gone = stage(gone.select(F.col("place").alias(place)), "exact-dropped")
    return rows.join(gone, place, "left_anti").select(*[rows[c] for c in docs.columns])
