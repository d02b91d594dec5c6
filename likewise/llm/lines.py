"""Repeated lines dropped across documents.

Lines are exploded and hashed; a hash found in enough documents loses all its lines but those
of the smallest document holding it. Only hashes, ids and places are shuffled. The lines of a
document are put together again by position, from the document's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.llm import text as tx
from likewise.sources.staging import stage

#: Keys shorter than this are too common to count as repeated.
MIN_CODE_POINTS = 10

#: A key found in so many documents is a repeated one.
MIN_DOCUMENTS = 2

#: The characters stripped at both ends of a line.
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return tx.ascii_lower(F.btrim(line, F.lit(SPACE)))


def drop_repeated_lines(
    docs: DataFrame,
    min_code_points: int = MIN_CODE_POINTS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text.

    A null or empty text has one empty line. Rows that repeat a doc_id count as one document,
    so none of them loses a line to another. A null doc_id counts as one document that comes
    after all others. An empty table gives an empty one. Other columns are not looked at.
    """
    text = tx.whole(F.col("text"))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("row"),
    )
    # The hashes are read twice below, the texts only once for them.
    lines = stage(
        texts.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_code_points)
        .select("doc_id", "row", "pos", F.unhex(F.md5("key")).alias("hash")),
        "line-hashes",
    )
    # Distinct (hash, document) pairs come first: a line that a third of all documents hold is
    # then counted from partial sums.
    repeated = (
        lines.select("hash", "doc_id")
        .distinct()
        .groupBy("hash")
        .agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") >= min_documents)
        .select("hash", "keeper")
    )
    # One row per hash on the right: the rows of a hot hash on the left can be split at will.
    dropped = (
        lines.join(repeated, "hash")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "row")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
        .withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    )
    whole, gone = F.split("text", "\n", -1), F.coalesce("gone", F.array().cast("array<int>"))
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), gone),
        F.concat(gone, F.array(F.size(whole))),
        lambda before, after: F.slice(whole, before + 2, after - before - 1),
    )
    same = texts["doc_id"].eqNullSafe(dropped["_id"]) & (texts["row"] == dropped["_row"])
    return texts.join(dropped, same, "left").select(
        "doc_id",
        F.size(whole).cast("bigint").alias("n_lines"),
        F.size(gone).cast("bigint").alias("n_dropped"),
        F.when(F.size(gone) == 0, F.col("text"))
        .otherwise(F.array_join(F.flatten(runs), "\n"))
        .alias("kept_text"),
    )
