"""Filling up short answers with the best-ranked items a query's rules allow.

Places read are (answers missing) + (answers excluded), never queries x items: the
ranked items are cut into pages, and queries are joined to the pages they need. What a rule
set allows is read off bitmaps over the ranking. Fills become rows last of all, and are not
shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likewise.operators.bitmaps import allowed_places, select_places
from likewise.operators.groups import deal, top_per_group
from likewise.operators.intervals import date_index
from likewise.operators.model import Model
from likewise.operators.querying import RULE_COLUMNS, date_rules_pass, rules_pass
from likewise.params import EngineParams
from likewise.sources.staging import stage

#: Ranked items per page. A page is what a query or a rule set reads at a time.
PAGE = 256

#: Dates are first tested on the best items that a rule set's fields allow: on so many pages of
#: them, and so many times what it needs.
FIRST_PAGES, GROWTH = 4, 8


def _page(position: str):
    return F.floor((F.col(position) - 1) / PAGE).cast("bigint")


def _field_sets(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule sets with ``set`` and ``look``, the distinct field rules by ``set`` with ``upto``).

    ``look`` is how many of the items that the fields allow a rule set reads at first: as many as it
    needs, or more where dates have to be tested on them. Set 0 has no field rules.
    """
    text = F.to_json(F.struct("filters", "excludes"))
    dated = F.col("date_name").isNotNull() | F.col("now").isNotNull()
    look = F.when(dated, F.greatest(F.col("need") * GROWTH, F.lit(FIRST_PAGES * PAGE))).otherwise(F.col("need"))
    bare = (F.size("filters") == 0) & (F.size("excludes") == 0)
    sigs = sigs.withColumn("look", look).withColumn("fields", F.when(~bare, text))
    sets = sigs.where(F.col("fields").isNotNull()).groupBy("fields").agg(
        F.any_value("filters").alias("filters"),
        F.any_value("excludes").alias("excludes"),
        F.max("look").alias("upto"),
    )
    sets = stage(sets.withColumn("set", F.monotonically_increasing_id() + 1), "field-sets")
    numbered = sigs.join(sets.select("fields", "set"), "fields", "left")
    return stage(numbered.withColumn("set", F.coalesce("set", F.lit(0))).drop("fields"), "open"), sets


def eligible_items(sigs: DataFrame, model: Model, params: EngineParams) -> DataFrame:
    """(sig, place, pos): the best-ranked items passing each rule set, at least ``need`` if there are.

    Field rules are bitmaps, and what passes them is read off in the order of the ranking, as far
    as it is needed. Dates are tested on what is read. A rule set that lacks items after the
    first look reads the rest: a date range the items inside it, from the dates' own order, and a
    moment all that its fields allow. Two looks, whatever the rules are.
    """
    sigs, sets = _field_sets(sigs)
    n_items = model.items.agg(F.count("*")).scalar()
    parts = allowed_places(sets, model, params.event_names)
    parts = stage(parts, "allowed-places")
    first = stage(select_places(parts.join(sets.select("set", "upto"), "set")), "first-places")
    reach = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("look", n_items)))
    free = sigs.where("set = 0").select("*", reach.alias("rank")).withColumn("pos", F.col("rank"))
    looked = sigs.where("set != 0").join(first, "set").where(F.col("rank") <= F.col("look"))
    looked = free.unionByName(looked.select(*free.columns))

    undated = F.col("date_name").isNull() & F.col("now").isNull()
    found = looked.where(undated).select("sig", F.col("rank").alias("place"), "pos")
    dated = sigs.where(~undated)
    if not params.date_columns:
        # a moment is only given where there are dates, a range without any passes nothing
        return found
    dates = model.items.select("pos", *params.date_columns)
    passed = looked.where(~undated).join(dates, "pos").where(date_rules_pass(params)).select("sig", "pos")
    passed = stage(passed, "dated")
    sizes = parts.groupBy("set").agg(F.sum("n").alias("size"))
    got = passed.groupBy("sig").agg(F.count("*").alias("got"))
    more = (
        dated.join(sizes, "set", "left")
        .withColumn("size", F.when(F.col("set") == 0, n_items).otherwise(F.coalesce("size", F.lit(0))))
        .join(got, "sig", "left")
        .where((F.coalesce("got", F.lit(0)) < F.col("need")) & (F.col("look") < F.col("size")))
        .drop("got")
    )
    more = stage(more, "second-look")
    if not more.isEmpty():
        passed = passed.unionByName(_second_look(more, parts, model, params)).distinct()
    largest = sigs.agg(F.max("need")).first()[0]
    placed = top_per_group(passed, ["sig"], [F.col("pos")], largest, rank="place")
    return found.unionByName(placed.select("sig", F.col("place").cast("bigint").alias("place"), "pos"))


def _second_look(more: DataFrame, parts: DataFrame, model: Model, params: EngineParams) -> DataFrame:
    """(sig, pos): all items that pass these rule sets, those inside ranges once more."""
    dates = model.items.select("pos", *params.date_columns)
    at = more.where(F.col("now").isNotNull())
    fields = at.where("set != 0").groupBy("set").agg(F.max("size").alias("upto"))
    listed = at.join(select_places(parts.join(fields, "set")), "set").where(F.col("rank") > F.col("look"))
    rest = F.explode(F.sequence(F.col("look") + 1, F.col("size")))
    free = at.where("set = 0").select("*", rest.alias("rank")).withColumn("pos", F.col("rank"))
    tested = free.unionByName(listed.select(*free.columns)).join(dates, "pos")
    passed = tested.where(date_rules_pass(params)).select("sig", "pos")
    for name in params.date_columns:
        ranged = more.where(F.col("date_name") == name)
        index = stage(date_index(model.items, name), f"index-{name}")
        ends = index.groupBy("date").agg(F.min("idx").alias("from"), F.max("idx").alias("to"))
        low = ends.select(F.col("date").alias("after"), (F.col("to") + 1).alias("lo"))
        high = ends.select(F.col("date").alias("before"), (F.col("from") - 1).alias("hi"))
        n_dated = index.agg(F.count("*")).scalar()
        # bounds lie on dates of items, or beyond all of them
        inside = ranged.join(low, "after", "left").join(high, "before", "left").select(
            "sig",
            "set",
            "look",
            *RULE_COLUMNS,
            F.coalesce("lo", F.lit(1)).alias("lo"),
            F.coalesce("hi", n_dated).alias("hi"),
        )
        reach = F.explode(F.sequence("lo", "hi"))
        listed = inside.where("lo <= hi").select("sig", "set", "look", *RULE_COLUMNS, reach.alias("idx"))
        tested = listed.join(index.select("idx", "pos"), "idx").join(model.items.select("pos", "props", *params.date_columns), "pos")
        passed = passed.unionByName(tested.where(rules_pass(params)).select("sig", "pos"))
    return passed


def _pages_wanted(short: DataFrame) -> DataFrame:
    """One row per query and page of the ranking it needs."""
    last = F.floor((F.col("need") - 1) / PAGE).cast("bigint")
    return short.withColumn("page", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def backfill(
    short: DataFrame, taken: DataFrame, rules: DataFrame | None, model: Model, params: EngineParams
) -> tuple[DataFrame, DataFrame]:
    """The items that fill up each query, and (pos) all places that these may have.

    ``short`` holds (query_id, sig, deficit) and what else its fills are to carry, ``taken`` the
    items (query_id, sig, pos) a query may not be filled with, ``rules`` the rule sets by ``sig``.
    Fills are the rows of ``short`` with ``pos`` and ``fill``, from 1 to the deficit. Among the first
    deficit + |taken| allowed items, at least ``deficit`` are not taken.

    Queries without rules need no list of items at all: their ranking is the places
    1, 2, 3 and so on. What is shuffled and sorted are pages and taken places; a page becomes
    its fills where it lies, numbered from what the pages before it have left.
    """
    carried = short.columns
    blocked = taken.groupBy("query_id").agg(F.count("*").alias("n_taken"))
    short = short.join(blocked, "query_id", "left").withColumn(
        "need", F.col("deficit") + F.coalesce("n_taken", F.lit(0))
    )
    short = stage(short.drop("n_taken"), "short")

    n_items = model.items.agg(F.count("*")).scalar()
    free = short.where(F.col("sig") == 0).withColumn("need", F.least("need", n_items))
    free = free.where(F.col("need") > 0)
    wanted = _pages_wanted(free)
    places = model.items.select("pos").where(F.col("pos") <= free.agg(F.max("need")).scalar())
    out = taken.where(F.col("sig") == 0).select("query_id", _page("pos").alias("page"), "pos")

    if rules is not None:
        ruled = short.where(F.col("sig") != 0)
        sigs = ruled.groupBy("sig").agg(F.max("need").alias("need")).join(rules, "sig")
        allowed = eligible_items(sigs, model, params)
        allowed = stage(allowed.withColumn("page", _page("place")), "allowed")
        wanted = wanted.unionByName(_pages_wanted(ruled))
        places = places.unionByName(allowed.select("pos"))
        met = taken.where(F.col("sig") != 0).join(allowed.select("sig", "pos", "page"), ["sig", "pos"])
        out = out.unionByName(met.select("query_id", "page", "pos"))

    out = out.groupBy("query_id", "page").agg(F.collect_set("pos").alias("out"))
    nothing = F.array().cast("array<bigint>")
    pages = wanted.join(out, ["query_id", "page"], "left").withColumn("out", F.coalesce("out", nothing))
    pages = deal(pages, "query_id")
    before = Window.partitionBy("query_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.coalesce(F.sum(F.size("out")).over(before), F.lit(0))
    pages = pages.withColumn("filled", F.col("page") * PAGE - lost).where(F.col("filled") < F.col("deficit"))

    upto = F.least(F.col("need"), (F.col("page") + 1) * PAGE)
    if rules is not None:
        pages = stage(pages, "fill-pages")
    listed = pages.where(F.col("sig") == 0).withColumn("all", F.sequence(F.col("page") * PAGE + 1, upto))
    if rules is not None:
        # a page's items are one row, however many queries share the rules
        lists = allowed.groupBy("sig", "page").agg(F.collect_list("pos").alias("all"))
        own = pages.where(F.col("sig") != 0).join(lists, ["sig", "page"])
        listed = listed.unionByName(own.select(*listed.columns))
    left = F.sort_array(F.array_except("all", "out"))
    left = F.slice(left, F.lit(1), F.least(F.col("deficit") - F.col("filled"), F.lit(PAGE)).cast("int"))
    filled = listed.select(*carried, "filled", F.posexplode(left).alias("nth", "pos"))
    return filled.select(*carried, "pos", (F.col("filled") + F.col("nth") + 1).alias("fill")), places
