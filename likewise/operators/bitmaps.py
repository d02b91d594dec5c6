"""Sets of items as bitmaps over their places in the ranking.

A part is 32,768 neighbouring places, one of Spark's bitmaps. A common term has a stored bitmap in
every part in which it is found; a rare one, whose places are a single row of the postings, gets
its bitmaps when they are asked for. Rules are sums and intersections of bitmaps; the answers are read
off them in the order of the ranking, from the first part on, as many as are needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likewise.sources.staging import stage

if TYPE_CHECKING:
    from likewise.operators.model import Model

#: Places in a part.
PART = 1 << 15
_WORDS = PART // 64

#: Items from which a term's bitmaps are stored.
COMMON = 1024

_NONE = "array<bigint>"


def _bitmaps(placed: DataFrame) -> DataFrame:
    """(field, term, part, bits) from (field, term, pos).

    Places meet by part before anything is combined: bitmaps made before the shuffle would be 4 KB for
    a few places each, which shrink on the way and grow again in the task that sorts them.
    """
    key = ["field", "term", "part"]
    parted = placed.select("field", "term", F.expr(f"(pos - 1) div {PART}").alias("part"), "pos")
    return parted.repartition(*key).groupBy(*key).agg(
        F.bitmap_construct_agg(F.expr(f"(pos - 1) % {PART}")).alias("bits")
    )


def build_bitmaps(
    postings: DataFrame, weights: DataFrame, items: DataFrame, event_names: Sequence[str]
) -> DataFrame:
    """(field, term, part, bits) of the common values of item properties.

    Postings under the name of an event type are those of correlators; such fields have none.
    """
    fields = items.select(F.explode(F.map_keys("props")).alias("field")).distinct()
    fields = fields.where(~F.col("field").isin(list(event_names)))
    common = weights.where(F.col("df") >= COMMON).join(fields, "field", "left_semi")
    lists = postings.join(common.select("field", "term"), ["field", "term"], "left_semi")
    return _bitmaps(lists.select("field", "term", F.explode("places").alias("pos")))


def wanted_bitmaps(wanted: DataFrame, model: Model, event_names: Sequence[str]) -> DataFrame:
    """(field, term, part, bits) of the property values in ``wanted`` (field, term), distinct ones."""
    key = ["field", "term"]
    named = F.col("field").isin(list(event_names))
    rare = wanted.where(~named)
    parts = []
    if model.bitmaps is not None:
        parts.append(model.bitmaps.join(rare, key, "left_semi"))
        rare = rare.join(parts[0].select(*key).distinct(), key, "left_anti")
    lists = model.postings.join(rare, key, "left_semi")
    parts.append(_bitmaps(lists.select(*key, F.explode("places").alias("pos"))))
    # a property that is called like an event type shares its postings: it is read from the items
    described = model.items.select("pos", F.explode("props").alias("field", "values")).where(named)
    described = described.select("field", F.explode(F.array_distinct("values")).alias("term"), "pos")
    parts.append(_bitmaps(described.join(wanted.where(named), key, "left_semi")))
    return reduce(DataFrame.unionByName, parts)


def _words(bits: Column) -> Column:
    """A bitmap as 512 numbers; the first byte of each is the highest."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(_WORDS - 1)),
        lambda i: F.conv(F.hex(F.substring(bits, i * 8 + 1, F.lit(8))), 16, -10).cast("bigint"),
    )


def _bit(place: Column) -> Column:
    """Where in its number the bit of one of 64 places is."""
    return (F.lit(7) - F.floor(place / 8)) * 8 + place % 8


def _full(size: Column) -> Column:
    """The numbers of a part that has its first ``size`` places only."""
    every, none = F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")

    def some(n: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), n - 1),
            none,
            lambda x, p: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(p).cast("int"))),
        )

    def word(i: Column) -> Column:
        left = (size - i * 64).cast("int")
        return F.when(left >= 64, every).when(left <= 0, none).otherwise(some(left))

    return F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), word)


def _places(words: Column, part: Column) -> Column:
    """The places of a part whose bits are set, in order."""
    bits = F.sequence(F.lit(0), F.lit(63))

    def of(x: Column, i: Column) -> Column:
        own = F.filter(bits, lambda p: F.bit_get(x, _bit(p).cast("int")) == 1)
        return F.when(x != 0, F.transform(own, lambda p: part * PART + i * 64 + p + 1)).otherwise(
            F.array().cast(_NONE)
        )

    return F.flatten(F.transform(words, of))


def _count(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda n, x: n + F.bit_count(x))


def allowed_places(sets: DataFrame, model: Model, event_names: Sequence[str]) -> DataFrame:
    """(set, part, words, before, n): where the places are that pass the field rules of each set.

    ``sets`` is (set, filters, excludes), rules as in queries: every filter needs one of its values,
    no exclusion may find one of its own. ``before`` counts the places of the parts before. Parts
    without places are left out. Nothing but bitmaps is read.
    """
    values = (
        sets.select("set", F.posexplode("filters").alias("rule", "r"))
        .unionByName(sets.select("set", F.lit(-1).alias("rule"), F.explode("excludes").alias("r")))
        .select("set", "rule", F.col("r.name").alias("field"), F.explode("r.values").alias("term"))
        .distinct()
    )
    values = stage(values, "rule-values")
    bitmaps = wanted_bitmaps(values.select("field", "term").distinct(), model, event_names)
    met = values.join(bitmaps, ["field", "term"]).groupBy("set", "rule", "part")
    met = stage(met.agg(F.bitmap_or_agg("bits").alias("bits")), "rule-bitmaps")
    together = met.where("rule >= 0").groupBy("set", "part").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n_met")
    )
    filtered = sets.where(F.size("filters") > 0).select("set", F.size("filters").alias("n_filters"))
    within = (
        together.join(filtered, "set")
        .where("n_met = n_filters")
        .select("set", "part", _words(F.col("bits")).alias("words"))
    )
    n_items = model.items.agg(F.count("*")).scalar()
    last = F.floor((n_items - 1) / PART).cast("bigint")
    every = (
        sets.where(F.size("filters") == 0)
        .select("set", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
        .withColumn("size", F.least(F.lit(PART), n_items - F.col("part") * PART))
        .select("set", "part", _full(F.col("size")).alias("words"))
    )
    out = met.where("rule = -1").select("set", "part", _words(F.col("bits")).alias("out"))
    base = within.unionByName(every).join(out, ["set", "part"], "left")
    words = F.when(F.col("out").isNull(), F.col("words")).otherwise(
        F.zip_with("words", "out", lambda x, y: x.bitwiseAND(F.bitwise_not(y)))
    )
    counted = base.select("set", "part", words.alias("words")).withColumn("n", _count(F.col("words")))
    before = Window.partitionBy("set").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # the bitmaps are written once; where places begin is summed over numbers alone
    counted = stage(counted.where("n > 0"), "allowed-parts")
    starts = counted.select("set", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return counted.join(starts, ["set", "part"])


def select_places(parts: DataFrame) -> DataFrame:
    """(set, rank, pos): the places in ``parts`` with ranks up to ``upto``, a column of theirs."""
    needed = parts.where(F.col("before") < F.col("upto"))
    listed = needed.select(
        "set", "before", "upto", F.posexplode(_places(F.col("words"), F.col("part"))).alias("i", "pos")
    )
    rank = F.col("before") + F.col("i") + 1
    return listed.where(rank <= F.col("upto")).select("set", rank.alias("rank"), "pos")
