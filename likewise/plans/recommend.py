"""Answering a table of queries in one batch."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likewise.functions.scores import fixed6
from likewise.operators.backfill import backfill
from likewise.operators.boosting import boosted, boosted_only, query_boosts
from likewise.operators.groups import top_per_group
from likewise.operators.intervals import share_moments
from likewise.operators.querying import (
    all_field_rules,
    complete_queries,
    exclusions,
    number_signatures,
    query_terms,
    rules_pass,
    with_rules,
)
from likewise.operators.scoring import term_sums
from likewise.params import EngineParams
from likewise.operators.model import Model
from likewise.plans.train import present_events
from likewise.sources.history import History
from likewise.sources.staging import hash_slices, passing_shuffles, stage, stage_parts
from likewise.sources.tables import usage_events

#: Matches of a wave of queries, about.
WAVE = 1 << 29

#: Queries that are one wave, whatever they match.
FEW = 1 << 14


def scored_hits(
    asked: DataFrame,
    usage: DataFrame,
    taken: DataFrame,
    model: Model,
    rules: DataFrame | None,
    params: EngineParams,
    largest: int,
) -> DataFrame:
    """(query_id, sig, pos, score, rnk): matched items each query may return, best first.

    Rules are tested once for each rule set and matched item, however many queries share them;
    queries without rules take no part in it, and items are not even read if no query has
    rules. What is left of a query is cut before its shuffle.
    """
    terms = query_terms(asked, usage, model.correlators, params)
    scores = term_sums(terms, model.postings, taken)
    boosts = stage(query_boosts(asked, model.weights, params), "boosts")
    any_boost = not boosts.isEmpty()
    if any_boost:
        scores = boosted(scores, boosts, model.items)
    scores = scores.withColumn("score", fixed6(F.col("score")))
    if rules is not None:
        scores = stage(scores, "scores")
        ruled = scores.where("sig != 0").join(rules.select("sig", "required"), "sig")
        required_met = F.col("bits").bitwiseAND(F.col("required")) == F.col("required")
        ruled = ruled.where(required_met & ((F.col("score") > 0) | (F.col("required") != 0)))
        described = model.items.select("pos", "props", *params.date_columns)
        passing = (
            ruled.select("sig", "pos")
            .distinct()
            .join(described, "pos")
            .join(rules.drop("rules"), "sig")
            .where(rules_pass(params))
            .select("sig", "pos")
        )
        ruled = ruled.join(passing, ["sig", "pos"], "left_semi").drop("required")
        allowed = scores.where("sig = 0 AND score > 0").unionByName(ruled.select(*scores.columns))
    else:
        allowed = scores.where(F.col("score") > 0)
    allowed = allowed.select("query_id", "sig", "pos", "score")
    order = [F.col("score").desc(), F.col("pos")]
    if any_boost:
        # what matches anything is kept whole here: the second wave has to know it
        allowed = stage(allowed, "matched")
        best = top_per_group(allowed.drop("sig"), ["query_id"], order, largest)
        page_end = (F.col("num") + F.col("from")).alias("page_end")
        bounds = asked.select("query_id", page_end, "required")
        more = boosted_only(bounds, boosts, allowed, best, taken, rules, model, params)
        allowed = allowed.unionByName(more.select(*allowed.columns))
    return top_per_group(allowed, ["query_id"], order, largest)


def histories(asked: DataFrame, events: DataFrame | History, params: EngineParams) -> DataFrame:
    """(user, event, item, event_time): all that the queried users did, for terms and exclusions.

    Written once, so the log or its layout by user is read a single time.
    """
    names = list(dict.fromkeys(params.event_names + params.blacklisting_events))
    users = asked.where(F.col("user").isNotNull()).select("user").distinct()
    if isinstance(events, History):
        return stage(events.of(users, names), "histories")
    return stage(usage_events(events, names).join(users, "user", "left_semi"), "histories")


def waves(asked: DataFrame, usage: DataFrame, model: Model, params: EngineParams) -> list[Column]:
    """Conditions on ``query_id`` that cut the batch into waves of about ``WAVE`` matches.

    A match is a place in the postings of a query's term. They are counted by term, not made.
    """
    if asked.count() <= FEW:
        return hash_slices(1)
    with passing_shuffles(asked.sparkSession):
        terms = query_terms(asked, usage, model.correlators, params)
        terms = terms.groupBy("field", "term").agg(F.count("*").alias("n"))
        met = terms.join(model.weights.select("field", "term", "df"), ["field", "term"])
        matches = met.agg(F.sum(F.col("n") * F.col("df")).alias("n")).collect()[0]["n"] or 0
    return hash_slices(-(-matches // WAVE), "query_id")


def recommend(
    queries: DataFrame,
    model: Model,
    events: DataFrame | History,
    params: EngineParams,
    now: datetime | str | None = None,
) -> DataFrame:
    """(query_id, pos, item, score, ranks): results in order, ``pos`` from 1.

    ``events`` is the current log, or a history laid out by user, from which users' histories
    are read, once. ``now`` is the date for availability rules of queries that give none.

    What a batch matches, and its answers while they get their items' names, are many times the
    queries. A large batch is answered in waves, one after another, and its answers are written.
    """
    if isinstance(events, History):
        params = params.with_events(events.event_names())
        user_type = events.user_type
    else:
        params = present_events(events, params)
        user_type = events.schema["entity_id"].dataType
    item_type = model.items.schema["item"].dataType
    moment = F.lit((now if isinstance(now, str) else now.isoformat()) if now else None)
    moment = moment.cast("timestamp") if now else F.current_timestamp()

    # within the batch a query is a number, whatever its id is made of
    asked = complete_queries(queries, params, user_type, item_type)
    asked = with_rules(all_field_rules(asked, params), params, moment)
    asked = asked.withColumnRenamed("query_id", "_name")
    asked = stage(asked.withColumn("query_id", F.monotonically_increasing_id()), "queries")
    asked, rules = number_signatures(share_moments(asked, model.items, params))
    usage = histories(asked, events, params)
    cuts = waves(asked, usage, model, params)
    if len(cuts) == 1:
        return answers(asked, usage, model, rules, params)
    own = [partial(answers, asked.where(cut), usage, model, rules, params) for cut in cuts]
    return stage_parts(asked.sparkSession, own, "answers")


def answers(
    asked: DataFrame, usage: DataFrame, model: Model, rules: DataFrame | None, params: EngineParams
) -> DataFrame:
    """(query_id, pos, item, score, ranks) of these queries, numbered and with their rules' ``sig``."""
    page = F.col("num") + F.col("from")
    largest = asked.agg(F.max(page).alias("n")).first()["n"] or 0
    places = model.items.select("item", "pos")
    taken = exclusions(asked, usage, params).join(places, "item")
    taken = stage(taken.select("query_id", "sig", "pos"), "exclusions")
    scored = partial(scored_hits, asked, usage, taken, model, rules, params, largest)
    hits = stage_parts(asked.sparkSession, [scored], "hits")

    shown = ["_name", "with_ranks", "pos", "score", "rnk"]
    bounds = asked.select("query_id", "_name", "num", "from", "with_ranks")
    paged = hits.withColumn("rnk", F.col("rnk").cast("bigint")).join(bounds, "query_id")
    paged = paged.where((F.col("rnk") > F.col("from")) & (F.col("rnk") <= page)).select(*shown)
    places = paged.select("pos")
    if params.recs_model != "collabFiltering":
        n_hits = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
        short = (
            asked.where(F.col("required") == 0)
            .select("query_id", "sig", "_name", "from", "with_ranks", page.alias("page_end"))
            .join(n_hits, "query_id", "left")
            .withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
            .withColumn("deficit", F.col("page_end") - F.col("n_hits"))
            .where(F.col("deficit") > 0)
        )
        used = taken.unionByName(hits.select("query_id", "sig", "pos"))
        # fills are many times the queries: all that they show comes with them, and is not joined again
        fills, filling = backfill(short.drop("page_end"), used, rules, model, params)
        fills = fills.withColumn("score", F.lit(0.0)).withColumn("rnk", F.col("fill") + F.col("n_hits"))
        paged = paged.unionByName(fills.where(F.col("rnk") > F.col("from")).select(*shown))
        places = places.unionByName(filling)

    return with_ranks(paged, model, params, places).select(
        F.col("_name").alias("query_id"), F.col("rnk").alias("pos"), "item", "score", "ranks"
    )


def with_ranks(answers: DataFrame, model: Model, params: EngineParams, places: DataFrame) -> DataFrame:
    """Adds the item at each place, and its ``ranks`` where the query asks for them.

    ``places`` (pos) holds all places of the answers. The items there are written once, so that
    their true size, not the catalog's, decides how they are joined: few enough are sent to the
    answers, however many items there are.
    """
    names = [c for c in params.rank_columns if c in model.items.columns]
    ranks = F.lit(None).cast("map<string,double>")
    if names:
        pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names))
        ranks = F.map_filter(pairs, lambda _, value: value.isNotNull())
    shown = stage(model.items.select("pos", "item", *names).join(places.distinct(), "pos", "left_semi"), "names")
    named = shown.select("pos", "item", ranks.alias("ranks"))
    return answers.join(named, "pos").withColumn(
        "ranks", F.when(F.col("with_ranks"), F.col("ranks"))
    )
