"""Boosts by field rules, without matching every item that has a boosted value.

A boosted value is often common: half the catalog may have it. What else a query asks for is matched
first, and the best answers so far, boosts included, say what an item that only has boosted values
must reach. The boosts alone add up to so much and no more: most queries are done then. The others
read, for each combination of their values that can reach it, the best-ranked items that have them
all, as many as can matter. Both steps give the very same answers as matching everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.functions.scores import fixed6
from likewise.operators.backfill import eligible_items
from likewise.operators.groups import top_per_group
from likewise.operators.model import Model
from likewise.operators.querying import RULE_COLUMNS, boost_terms, rules_pass
from likewise.params import EngineParams
from likewise.sources.staging import stage

#: Boosted values up to which every combination is a rule set of its own; with more, the items of the
#: values are added up once for all queries that boost the same.
COMBINED = 4

_FILTERS = "array<struct<name:string,values:array<string>>>"


def query_boosts(asked: DataFrame, weights: DataFrame, params: EngineParams) -> DataFrame:
    """(query_id, sig, boosts): what each boosted property value adds to an item, per query.

    Values under the name of an event type are correlators; they are matched like histories.
    """
    terms = boost_terms(asked).where(~F.col("field").isin(params.event_names))
    gained = (
        terms.join(weights.select("field", "term", "idf"), ["field", "term"])
        .groupBy("query_id", "sig", "field", "term")
        .agg(F.sum(F.col("boost") * F.col("idf")).alias("gain"))
    )
    entry = F.struct("field", "term", "gain")
    return gained.groupBy("query_id", "sig").agg(F.array_sort(F.collect_list(entry)).alias("boosts"))


def _added(boosts: Column, props: Column) -> Column:
    """What the boosts add to an item with these properties."""
    return F.aggregate(
        boosts,
        F.lit(0.0),
        lambda total, b: total
        + F.when(F.coalesce(F.array_contains(props[b["field"]], b["term"]), F.lit(False)), b["gain"]).otherwise(0.0),
    )


def boosted(scores: DataFrame, boosts: DataFrame, items: DataFrame) -> DataFrame:
    """``scores`` (query_id, pos, score, ...) with the boosts added: only items at hand are looked up."""
    columns = scores.columns
    own = boosts.select("query_id", "boosts")
    plain = scores.join(own.select("query_id"), "query_id", "left_anti")
    met = scores.join(own, "query_id").join(items.select("pos", "props"), "pos")
    total = F.col("score") + _added(F.col("boosts"), F.col("props"))
    return plain.unionByName(met.withColumn("score", total).select(*columns))


def _combinations(open_: DataFrame) -> DataFrame:
    """(query_id, sig, need, values): the combinations of boosted values that may reach the bound."""
    masks = F.explode(F.sequence(F.lit(1), F.expr("cast(shiftleft(1, size(boosts)) - 1 as int)")))
    chosen = open_.select("*", masks.alias("mask")).withColumn(
        "chosen", F.expr("filter(boosts, (b, i) -> (shiftright(mask, i) & 1) = 1)")
    )
    reach = F.aggregate("chosen", F.lit(0.0), lambda total, b: total + b["gain"])
    values = F.transform("chosen", lambda b: F.struct(b["field"].alias("name"), F.array(b["term"]).alias("values")))
    return chosen.where(fixed6(reach) >= F.col("least")).select(
        "query_id", "sig", "need", values.cast(_FILTERS).alias("values")
    )


def _rule_sets(rules: DataFrame | None, model: Model) -> DataFrame:
    """(sig, rule columns) of all signatures, 0 with no rules at all included."""
    kinds = {"filters": _FILTERS, "excludes": _FILTERS, "date_name": "string", "required": "bigint"}
    blank = {
        "filters": F.array(),
        "excludes": F.array(),
        "required": F.lit(0),
    }
    none = [
        blank.get(c, F.lit(None)).cast(kinds.get(c, "timestamp")).alias(c) for c in RULE_COLUMNS
    ]
    bare = model.items.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("sig"), *none)
    return bare if rules is None else bare.unionByName(rules.select("sig", *RULE_COLUMNS))


def _listed(combined: DataFrame, rules: DataFrame, model: Model, params: EngineParams) -> DataFrame:
    """(query_id, sig, pos): for every combination the best-ranked items that have it."""
    key = F.to_json(F.struct("sig", "values"))
    combined = combined.withColumn("key", key)
    sets = combined.groupBy("key", "sig").agg(F.max("need").alias("need"), F.any_value("values").alias("values"))
    sets = stage(sets.withColumn("set_sig", F.monotonically_increasing_id()), "combinations")
    full = sets.join(rules, "sig").select(
        F.col("set_sig").alias("sig"),
        "need",
        F.concat("filters", "values").alias("filters"),
        *[c for c in RULE_COLUMNS if c != "filters"],
    )
    found = eligible_items(full, model, params).join(sets.select(F.col("set_sig").alias("sig"), "key"), "sig")
    return (
        combined.select("query_id", "sig", "need", "key")
        .join(found.select("key", "place", "pos"), "key")
        .where("place <= need")
        .select("query_id", "sig", "pos")
    )


def _added_up(open_: DataFrame, rules: DataFrame, model: Model, params: EngineParams) -> DataFrame:
    """(query_id, sig, pos): the best items by all boosts, found once for equal boosts and rules."""
    key = F.to_json(F.struct("sig", "boosts"))
    open_ = open_.withColumn("key", key)
    sets = stage(
        open_.groupBy("key", "sig").agg(F.max("need").alias("need"), F.any_value("boosts").alias("boosts")),
        "boost-sets",
    )
    largest = sets.agg(F.max("need")).first()[0]
    if largest is None:
        return open_.select("query_id", "sig", F.lit(0).cast("bigint").alias("pos")).limit(0)
    terms = sets.select("key", "sig", F.explode("boosts").alias("b")).select("key", "sig", "b.*")
    met = terms.join(model.postings.select("field", "term", "places"), ["field", "term"])
    sums = met.select("key", "sig", F.explode("places").alias("pos"), "gain").groupBy("key", "sig", "pos")
    sums = sums.agg(fixed6(F.sum("gain")).alias("score"))
    described = model.items.select("pos", "props", *params.date_columns)
    passing = sums.join(rules, "sig").join(described, "pos").where(rules_pass(params))
    best = top_per_group(
        passing.select("key", "pos", "score"), ["key"], [F.col("score").desc(), F.col("pos")], largest, rank="place"
    )
    return (
        open_.select("query_id", "sig", "need", "key")
        .join(best, "key")
        .where("place <= need")
        .select("query_id", "sig", "pos")
    )


def boosted_only(
    asked: DataFrame,
    boosts: DataFrame,
    matched: DataFrame,
    best: DataFrame,
    taken: DataFrame,
    rules: DataFrame | None,
    model: Model,
    params: EngineParams,
) -> DataFrame:
    """(query_id, sig, pos, score): items with nothing but boosted values that may be among the best.

    ``asked`` has (query_id, page_end, required), ``matched`` (query_id, pos, score) all allowed
    items that match anything else, boosts included, ``best`` the first of them with ``rnk``. Queries whose page is full of better
    ones than their boosts can make take no part, nor do those that demand other matches.
    """
    bound = (
        asked.where("required = 0")
        .join(boosts, "query_id")
        .join(matched.groupBy("query_id").agg(F.count("*").alias("n_matched")), "query_id", "left")
        .join(taken.groupBy("query_id").agg(F.count("*").alias("n_taken")), "query_id", "left")
        .join(
            best.select("query_id", F.col("rnk").alias("page_end"), F.col("score").alias("least")),
            ["query_id", "page_end"],
            "left",
        )
    )
    most = F.aggregate("boosts", F.lit(0.0), lambda total, b: total + b["gain"])
    least = F.coalesce("least", F.lit(0.0))
    need = F.col("page_end") + F.coalesce("n_matched", F.lit(0)) + F.coalesce("n_taken", F.lit(0))
    open_ = bound.where(fixed6(most) >= least).select(
        "query_id", "sig", "boosts", least.alias("least"), need.alias("need")
    )
    open_ = stage(open_, "boost-bounds")
    few = F.size("boosts") <= COMBINED
    every = _rule_sets(rules, model)
    found = _listed(_combinations(open_.where(few)), every, model, params).unionByName(
        _added_up(open_.where(~few), every, model, params)
    )
    key = ["query_id", "pos"]
    found = (
        found.select("query_id", "sig", "pos")
        .distinct()
        .join(taken.select(*key), key, "left_anti")
        .join(matched.select(*key), key, "left_anti")
        .withColumn("score", F.lit(0.0))
    )
    whole = boosted(found, boosts, model.items)
    return whole.withColumn("score", fixed6(F.col("score"))).where("score > 0")
