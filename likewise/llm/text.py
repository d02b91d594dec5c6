"""Column helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes that a Python worker is handed at a time.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most ``BATCH_BYTES``, for the rest of the session.

    By default a batch is 64 MB, several times of which each of an executor's workers needs.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole(text: Column) -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Only A-Z are lower-cased, whatever the locale or the script."""
    return F.translate(text, UPPER, UPPER.lower())


def digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, 64 lowercase hex characters."""
    return F.sha2(text, 256)


def count_runs(text: Column, gap: str) -> Column:
    """How many runs lie between the gaps; ``gap`` is a character class of a pattern."""
    pieces = F.size(F.split(text, f"{gap}+", -1))
    opens = text.rlike(f"^{gap}").cast("int")
    ends = F.substring(text, -1, 1).rlike(f"^{gap}").cast("int")
    return F.when(F.length(text) == 0, 0).otherwise(pieces - opens - ends).cast("bigint")


def running_starts(lengths: Column) -> Column:
    """[0, l0, l0+l1, ...]: where each of the consecutive pieces starts.

    Sums run inside blocks of 256 pieces and over the blocks' totals, so that a text with very
    many pieces doesn't cost their number squared.
    """

    def starts(xs: Column) -> Column:
        zero = F.array(F.lit(0).cast("bigint"))
        step = F.aggregate(
            xs, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )
        return F.slice(step, 1, F.size(xs))

    block = F.lit(256)
    blocks = F.when(
        F.size(lengths) > 0,
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")),
            lambda b: F.slice(lengths, b * block + 1, block),
        ),
    ).otherwise(F.array().cast("array<array<bigint>>"))
    totals = F.transform(
        blocks, lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    )
    offsets = starts(totals)
    return F.flatten(
        F.zip_with(blocks, offsets, lambda xs, o: F.transform(starts(xs), lambda s: s + o))
    )


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array<struct<start,end,match>> in code points.

    The pieces between the matches and the matches themselves add up to the text, so their
    lengths give the places. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
    lengths = F.zip_with(
        F.slice(gaps, 1, F.size(found)), found, lambda g, m: g + F.length(m)
    )
    spans = F.zip_with(
        F.zip_with(running_starts(lengths), gaps, lambda s, g: s + g),
        found,
        lambda s, m: F.struct(
            s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")
        ),
    )
    return F.filter(spans, lambda x: x["match"].isNotNull())
