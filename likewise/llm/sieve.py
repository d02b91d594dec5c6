"""A first, cheap choice of the rows whose key may be among others, without moving a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.llm.text import unused

#: Bits of the sieve, an eighth as many bytes: this is what is broadcast, whatever goes into it.
BITS = 1 << 26
_BITMAP = 1 << 15  # bits of one of Spark's bitmaps


def _slot(key: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits))


def sieve(
    rows: DataFrame, key: list[Column], members: DataFrame, member: list[Column], bits: int = BITS
) -> DataFrame:
    """The rows of ``rows`` whose key has the hash slot of some key of ``members``, and no others.

    All rows with a member's key stay, of the others one in ``bits`` / number of members. Keys of
    the same types are compared, nulls are left out of the hash, so they never lose a row. The slots
    are bitmaps of 4 KB built in the executors; together they have ``bits`` bits at most.
    """
    at, which, bits_of = (unused(rows, name) for name in ("_at", "_map", "_bits"))
    slots = members.select(_slot(member, bits).alias("slot"))
    maps = slots.groupBy(F.expr(f"slot div {_BITMAP}").alias(which)).agg(
        F.bitmap_construct_agg(F.expr(f"slot % {_BITMAP}")).alias(bits_of)
    )
    byte = F.expr(f"conv(hex(substring({bits_of}, cast({at} % {_BITMAP} div 8 + 1 as int), 1)), 16, 10)")
    told = byte.cast("int").bitwiseAND(F.expr(f"shiftleft(1, cast({at} % 8 as int))")) != 0
    joined = rows.withColumn(at, _slot(key, bits)).join(
        F.broadcast(maps), F.expr(f"{at} div {_BITMAP}") == F.col(which)
    )
    return joined.where(told).select(*[f"`{c}`" for c in rows.columns])
