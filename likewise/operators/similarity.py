"""Correlated cross-occurrence: which events go with which primary items."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.functions.scores import fixed6, log_likelihood_ratio
from likewise.operators.events import prepare
from likewise.operators.groups import top_per_group
from likewise.params import Indicator
from likewise.sources.staging import hash_slices, stage, stage_parts

#: An LLR that rounds to no more than this is independence, not correlation.
ZERO_LLR = 1e-6


#: Acts in a block of a user's basket.
BASKET = 256

#: Users up to which an item is light: its users' baskets meet in one task.
LIGHT = 256

#: Pairs that a task counts at a time, about.
PAIRS = 1 << 21

#: Pairs whose lists lie on the disks at a time, about.
SLICE = 1 << 29


def _baskets(interactions: DataFrame, primary: str) -> DataFrame:
    """(user, block, n_blocks, own, lists): a user's acts in blocks of about ``BASKET``.

    ``lists`` has the targets of each event type and their numbers of users side by side.
    """
    busy = (
        interactions.groupBy("user")
        .agg(F.ceil(F.count("*") / F.lit(BASKET)).cast("int").alias("n_blocks"))
        .where("n_blocks > 1")
    )
    n_blocks = F.coalesce("n_blocks", F.lit(1)).alias("n_blocks")
    block = F.pmod(F.xxhash64("event", "item"), F.col("n_blocks")).cast("int").alias("block")

    def listed(event: Column) -> Column:
        of = F.filter("acts", lambda a: a["event"] == event)
        return F.struct(
            event.alias("event"),
            F.transform(of, lambda a: a["item"]).alias("items"),
            F.transform(of, lambda a: a["n_users"]).alias("n_users"),
        )

    events = F.array_distinct(F.transform("acts", lambda a: a["event"]))
    return (
        interactions.join(busy, "user", "left")
        .select("user", "event", "item", "n_users", n_blocks)
        .groupBy("user", "n_blocks", block)
        .agg(
            F.collect_list(
                F.when(F.col("event") == primary, F.struct("item", "n_users"))
            ).alias("own"),
            F.collect_list(F.struct("event", "item", "n_users")).alias("acts"),
        )
        .select("user", "block", "n_blocks", "own", F.transform(events, listed).alias("lists"))
    )


def _counted(met: DataFrame, primary: str) -> DataFrame:
    """Pairs of an item with the acts beside it, counted."""
    pairs = (
        met.select("item", "n_item", F.explode("lists").alias("l"))
        .select("item", "n_item", "l.event", F.explode(F.arrays_zip("l.items", "l.n_users")).alias("b"))
        .select(
            "item",
            "event",
            F.col("b.items").alias("correlator"),
            "n_item",
            F.col("b.n_users").alias("n_correlator"),
        )
        .where((F.col("event") != primary) | (F.col("correlator") != F.col("item")))
    )
    return pairs.groupBy("item", "event", "correlator", "n_item", "n_correlator").agg(
        F.count("*").alias("n_both")
    )


def pair_slices(
    interactions: DataFrame, primary: str, secondary: bool = False, most: int | None = None
) -> list[Callable[[], DataFrame]]:
    """What makes (item, event, correlator, n_both, n_item, n_correlator), for some of the items each.

    There are as many slices as it takes for one to have about ``most`` pairs, or one without it.
    All pairs of an item are in one slice.

    ``interactions`` carry ``n_users`` (from :func:`with_margins`). With ``secondary``, pairs with
    targets of the primary event itself are left out. No basket is ever one row: a user's acts are
    dealt into blocks, and blocks meet blocks of the same user. What a light item meets goes to
    its task as lists, and becomes pairs only there: hardly any two of them are the same, so
    combining them before would shrink nothing. The pairs of other items are counted where they
    arise and again after the shuffle on all of (item, event, correlator), so no such item's pairs go
    to one task.
    """
    # a fixed number of tasks: merging small baskets by their size, as adaptive
    # execution would, ignores that each is about to grow quadratically
    tasks = int(interactions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    baskets = stage(_baskets(interactions, primary), "baskets")
    acts = F.aggregate("lists", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["items"]))
    n_pairs = baskets.agg(F.sum(F.size("own") * acts * F.col("n_blocks"))).first()[0] or 0
    n_slices = max(1, -(-n_pairs // most)) if most else 1
    lists = F.col("lists")
    if secondary:
        lists = F.filter("lists", lambda x: x["event"] != primary)
    right = baskets.select("user", F.col("block").alias("other"), lists.alias("lists"))
    right = right.where(F.size("lists") > 0).repartition(tasks, "user", "other")
    others = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")

    def met(of: Column) -> DataFrame:
        left = baskets.select("user", "n_blocks", of.alias("own")).where(F.size("own") > 0)
        left = left.select("user", others, "own").repartition(tasks, "user", "other")
        both = left.join(right, ["user", "other"]).select(F.explode("own").alias("a"), "lists")
        return both.select(F.col("a.item").alias("item"), F.col("a.n_users").alias("n_item"), "lists")

    def counted(i: int) -> DataFrame:
        own = F.col("own")
        if n_slices > 1:
            own = F.filter(own, lambda a: hash_slices(n_slices, a["item"])[i])
        light = met(F.filter(own, lambda a: a["n_users"] <= LIGHT))
        light = light.repartition(max(tasks, -(-n_pairs // (n_slices * PAIRS))), "item")
        common = met(F.filter(own, lambda a: a["n_users"] > LIGHT))
        return _counted(common, primary).unionByName(_counted(light, primary))

    return [partial(counted, i) for i in range(n_slices)]


def pair_counts(interactions: DataFrame, primary: str, secondary: bool = False) -> DataFrame:
    """(item, event, correlator, n_both, n_item, n_correlator) for all events at once."""
    return pair_slices(interactions, primary, secondary)[0]()


def cooccurrence_counts(interactions: DataFrame, primary: str) -> DataFrame:
    """Users having both of two primary items; an item is not paired with itself."""
    own = interactions.where(F.col("event") == primary)
    return pair_counts(own, primary).select("item", "correlator", "n_both")


def cross_occurrence_counts(interactions: DataFrame, primary: str) -> DataFrame:
    """Users having both a primary item and the target of a secondary event."""
    return pair_counts(interactions, primary, secondary=True).select(
        "item", "event", "correlator", "n_both"
    )


def llr_scores(pairs: DataFrame, users: DataFrame) -> DataFrame:
    """Adds ``llr``, six decimals; ``users`` are all users the pairs were drawn from."""
    return llr_of(pairs, users.agg(F.count("*")).scalar())


def llr_of(pairs: DataFrame, n: Column) -> DataFrame:
    """The same for a known number of users."""
    llr = log_likelihood_ratio(
        F.col("n_both"), F.col("n_item"), F.col("n_correlator"), n
    )
    return pairs.withColumn("llr", fixed6(llr))


def _per_event(indicators: Sequence[Indicator], attribute: str) -> Column:
    values = [(i.name, getattr(i, attribute)) for i in indicators]
    table = F.create_map(*[F.lit(x) for name, v in values if v is not None for x in (name, v)])
    return table[F.col("event")]


def llr_threshold(scored: DataFrame, indicators: Sequence[Indicator] = ()) -> DataFrame:
    """Drop independent pairs, and those below their indicator's ``min_llr``."""
    kept = scored.where(F.col("llr") > ZERO_LLR)
    if any(i.min_llr is not None for i in indicators):
        least = F.coalesce(_per_event(indicators, "min_llr").cast("double"), F.lit(0.0))
        kept = kept.where(F.col("llr") >= least)
    return kept


def top_correlators(scored: DataFrame, indicators: Sequence[Indicator]) -> DataFrame:
    """The strongest per item and event, strongest first, ties by correlator id."""
    best = top_per_group(
        scored,
        ["item", "event"],
        [F.col("llr").desc(), F.col("correlator")],
        max(i.max_correlators for i in indicators),
    )
    if len({i.max_correlators for i in indicators}) > 1:
        best = best.where(F.col("rnk") <= _per_event(indicators, "max_correlators"))
    return best.select("item", "event", "correlator", "llr", "rnk")


def correlators(
    interactions: DataFrame,
    indicators: Sequence[Indicator],
    min_events: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """(item, event, correlator, llr, rnk) from raw (user, event, item) interactions.

    Of more than ``SLICE`` pairs, those of some items are made at a time, and their best written
    before the next: the lists that are dealt by item are many times the interactions.
    """
    cut, users = prepare(interactions, indicators, min_events, seed)

    def best(pairs: Callable[[], DataFrame]) -> DataFrame:
        scored = llr_scores(pairs(), users)
        # the threshold only cuts the weak end of a ranked list, so it can follow the
        # ranking, where it is tested on the few rows left
        return llr_threshold(top_correlators(scored, indicators), indicators)

    slices = pair_slices(cut, indicators[0].name, most=SLICE)
    if len(slices) == 1:
        return best(slices[0])
    return stage_parts(cut.sparkSession, [partial(best, pairs) for pairs in slices], "best-pairs")


def correlator_lists(found: DataFrame) -> DataFrame:
    """(item, event, correlators): the ordered list of ids of each item and event."""
    ranked = F.sort_array(F.collect_list(F.struct("rnk", "correlator")))
    return found.groupBy("item", "event").agg(
        F.transform(ranked, lambda r: r["correlator"]).alias("correlators")
    )
