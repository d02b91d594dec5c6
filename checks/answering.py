"""Registered queries: one batch of recommendations per kind of query."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.logs import NOW, full_log, order_log, table
from checks.training import ORDER_PARAMS, PARAMS, Query, order_model, trained, usage_model
from likewise import EngineParams, FieldRule
from likewise.operators import querying as qu
from likewise.operators.scoring import term_match, term_score
from likewise.plans.recommend import recommend
from likewise.operators.model import Model
from likewise.plans.train import train
from likewise.sources.history import write_history
from likewise.sources.staging import staged_path
from likewise.sources.tables import usage_events

DATED = replace(PARAMS, available_date_name="available", expire_date_name="expires", date_name="date")


def dated_model(spark: SparkSession, sf_dir: str) -> Model:
    return trained(spark, sf_dir, "dated", lambda: train(full_log(spark, sf_dir), DATED, NOW))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user of the usage log asks once."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user")).distinct()
    return ids.select(F.col("user").alias("query_id"), "user")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of the catalog is asked about once."""
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item"))
    return ids.select(F.col("item").alias("query_id"), "item")


def rule(name: str, values: list[Column], bias: float) -> Column:
    return F.struct(
        F.lit(name).alias("name"), F.array(*values).alias("values"), F.lit(bias).alias("bias")
    )


def answer(
    spark: SparkSession,
    sf_dir: str,
    queries: DataFrame,
    params: EngineParams = PARAMS,
    model: Model | None = None,
) -> DataFrame:
    model = model or usage_model(spark, sf_dir)
    return recommend(queries, model, full_log(spark, sf_dir), params, NOW).select(
        "query_id", "pos", "item", "score"
    )


def key() -> Column:
    """The asking user's number, from which brands and dates are chosen."""
    return F.col("user").cast("bigint")


def brand() -> Column:
    return F.concat(F.lit("Brand#"), (key() % 25 + 1).cast("string"))


def size() -> Column:
    return (key() % 50 + 1).cast("string")


def user_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(spark, sf_dir, users(spark, sf_dir))


def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = tuple(replace(i, max_query_events=3) for i in PARAMS.indicators)
    return answer(spark, sf_dir, users(spark, sf_dir), replace(PARAMS, indicators=short))


def item_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(spark, sf_dir, parts(spark, sf_dir))


def item_set_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a cart, answered from correlators alone."""
    log = order_log(spark, sf_dir)
    carts = log.groupBy(F.floor(F.col("seq") / 10).alias("query_id")).agg(
        F.collect_set("target_entity_id").alias("item_set")
    )
    only_cf = replace(ORDER_PARAMS, recs_model="collabFiltering")
    return recommend(carts, order_model(spark, sf_dir), log, only_cf, NOW).select(
        "query_id", "pos", "item", "score"
    )


def mixed_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user looking at the part whose number is theirs."""
    return answer(spark, sf_dir, users(spark, sf_dir).withColumn("item", F.col("user")))


def event_name_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("view"), F.lit("click"))
    return answer(spark, sf_dir, users(spark, sf_dir).withColumn("event_names", names))


def cross_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People who viewed what you viewed purchased these."""
    return answer(spark, sf_dir, users(spark, sf_dir).withColumn("event_names", F.array(F.lit("view"))))


def popular_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers name neither user nor item: the rankings alone answer."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    return answer(spark, sf_dir, asked.withColumn("num", F.lit(7)))


def unknown_entity_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known and unknown users side by side, and items nobody has seen."""
    known = users(spark, sf_dir).withColumn("item", F.lit(None).cast("string"))
    strangers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("query_id"))
    asked = known.unionByName(
        strangers.withColumn("user", F.col("query_id")).withColumn("item", F.col("query_id"))
    )
    return answer(spark, sf_dir, asked.withColumn("num", F.lit(5)))


def _terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Model]:
    model = usage_model(spark, sf_dir)
    log = full_log(spark, sf_dir)
    kind = log.schema["entity_id"].dataType
    asked = qu.complete_queries(users(spark, sf_dir), PARAMS, kind, kind).withColumn("sig", F.lit(0).cast("bigint"))
    return qu.user_terms(asked, usage_events(log, PARAMS.event_names), PARAMS), model


def term_match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, model = _terms(spark, sf_dir)
    found = term_match(terms, model.postings).groupBy("query_id", "field", "pos").agg(
        F.count("*").alias("n_terms")
    )
    return found.join(model.items, "pos").select("query_id", "field", "item", "n_terms")


def term_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, model = _terms(spark, sf_dir)
    scores = term_score(terms, model.postings)
    return scores.join(model.items, "pos").select("query_id", "item", "score")


def bias_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = users(spark, sf_dir).withColumn("item", F.col("user"))
    return answer(spark, sf_dir, asked.withColumn("user_bias", F.lit(2.5)))


def bias_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = users(spark, sf_dir).withColumn("item", F.col("user"))
    return answer(spark, sf_dir, asked, replace(PARAMS, item_bias=3.0))


def bias_item_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user with a cart of the two parts next to their own number."""
    asked = users(spark, sf_dir).withColumn(
        "item_set", F.array((key() + 1).cast("string"), (key() + 2).cast("string"))
    )
    return answer(spark, sf_dir, asked.withColumn("item_set_bias", F.lit(1.5)))


def negative_bias_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item must match history of both event types; scores come from a boost."""
    names = F.array(F.lit("purchase"), F.lit("view"))
    boost = F.array(rule("brand", [brand()], 2.0))
    asked = users(spark, sf_dir).withColumn("event_names", names).withColumn("fields", boost)
    return answer(spark, sf_dir, asked, replace(PARAMS, user_bias=-1.0))


def field_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(rule("tags", [brand(), F.lit("ECONOMY")], 1.5), rule("size", [size()], 4.0))
    return answer(spark, sf_dir, users(spark, sf_dir).withColumn("fields", rules))


def field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand of two, and a type: values are alternatives, rules add up."""
    rules = F.array(
        rule("brand", [brand(), F.lit("Brand#3")], -1.0),
        rule("tags", [F.lit("ECONOMY"), F.lit("PROMO")], -1.0),
    )
    return answer(spark, sf_dir, users(spark, sf_dir).withColumn("fields", rules))


def field_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(rule("brand", [brand()], 0.0), rule("tags", [F.lit("STANDARD")], 0.0))
    return answer(spark, sf_dir, users(spark, sf_dir).withColumn("fields", rules))


def rule_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's rules meet each query's; the boost given twice counts once."""
    engine = replace(
        PARAMS,
        fields=(FieldRule("size", ("7",), 3.0), FieldRule("big", ("true",), 0.0)),
    )
    own = F.array(rule("size", [F.lit("7")], 3.0), rule("brand", [brand()], 2.0))
    return answer(spark, sf_dir, users(spark, sf_dir).withColumn("fields", own), engine)


def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an odd number give a date range, even ones a current date."""
    day = F.date_add(F.lit("2023-12-20").cast("date"), (key() % 40).cast("int")).cast("timestamp")
    odd = key() % 2 == 1
    asked = users(spark, sf_dir).withColumn("current_date", F.when(~odd, day)).withColumn(
        "date_range",
        F.when(
            odd,
            F.struct(
                F.lit("date").alias("name"),
                F.when(key() % 3 > 0, F.lit("2024-01-25T00:00:00").cast("timestamp")).alias("before"),
                day.alias("after"),
            ),
        ),
    )
    return answer(spark, sf_dir, asked, DATED, dated_model(spark, sf_dir))


def date_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user asks at a second of their own."""
    start = F.lit("2023-12-20T00:00:00").cast("timestamp")
    moment = F.timestamp_seconds(F.unix_seconds(start) + key() * 7919 % (86_400 * 40))
    asked = users(spark, sf_dir).withColumn("current_date", moment).withColumn("num", F.lit(30))
    return answer(spark, sf_dir, asked, DATED, dated_model(spark, sf_dir))


def narrow_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that few items pass: a size and not the user's brand, and a date range of some days."""
    rules = F.array(rule("size", [size()], -1.0), rule("brand", [brand()], 0.0))
    after = F.date_add(F.lit("2023-12-20").cast("date"), (key() % 40).cast("int")).cast("timestamp")
    ranged = F.struct(F.lit("date").alias("name"), (after + F.expr("INTERVAL 9 DAYS")).alias("before"), after.alias("after"))
    asked = users(spark, sf_dir).withColumn("fields", F.when(key() % 2 == 0, rules))
    asked = asked.withColumn("date_range", F.when(key() % 2 == 1, ranged)).withColumn("current_date", F.lit("2024-01-20").cast("timestamp"))
    return answer(spark, sf_dir, asked, DATED, dated_model(spark, sf_dir))


def history_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from a history laid out by user, written in two parts."""
    log, path = full_log(spark, sf_dir), staged_path(spark, "history")
    half = F.col("seq") % 2 == 0
    write_history(log.where(half), PARAMS.event_names, path, buckets=16)
    history = write_history(log.where(~half), PARAMS.event_names, path, buckets=16, append=True)
    found = recommend(users(spark, sf_dir), usage_model(spark, sf_dir), history, PARAMS, NOW)
    return found.select("query_id", "pos", "item", "score")


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More answers than matches: the whole catalog follows in ranking order."""
    return answer(spark, sf_dir, users(spark, sf_dir).withColumn("num", F.lit(400)))


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing viewed or clicked before, nothing listed, the own item allowed."""
    asked = users(spark, sf_dir).withColumn("item", F.col("user")).withColumn(
        "return_self", F.lit(True)
    ).withColumn("blacklist_items", F.array(F.lit("11"), (key() + 5).cast("string")))
    return answer(spark, sf_dir, asked, replace(PARAMS, blacklist_events=("view", "click")))


def exclude_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exclusions themselves, for carts and items of every user."""
    log = full_log(spark, sf_dir)
    kind = log.schema["entity_id"].dataType
    asked = users(spark, sf_dir).withColumn("item", F.col("user")).withColumn(
        "item_set", F.array((key() + 1).cast("string"))
    )
    asked = qu.complete_queries(asked, PARAMS, kind, kind).withColumn("sig", F.lit(0).cast("bigint"))
    return qu.exclusions(asked, usage_events(log, PARAMS.event_names), PARAMS).select("query_id", "item")


def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of fifteen: some pages end in the backfill."""
    asked = users(spark, sf_dir).withColumn("num", F.lit(15)).withColumn("from", F.lit(15))
    return answer(spark, sf_dir, asked)


def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer(spark, sf_dir, users(spark, sf_dir), replace(PARAMS, num=4))


def with_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = users(spark, sf_dir).withColumn("with_ranks", key() % 2 == 0)
    model = usage_model(spark, sf_dir)
    found = recommend(asked, model, full_log(spark, sf_dir), PARAMS, NOW)
    ranks = [F.col("ranks")[c].alias(c) for c in PARAMS.rank_columns]
    return found.select("query_id", "pos", "item", "score", *ranks)


def recs_model_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same users asked of all three kinds of model."""
    found = None
    for mode in ("all", "collabFiltering", "backfill"):
        params = replace(PARAMS, recs_model=mode)
        if mode == "all":
            model = usage_model(spark, sf_dir)
        else:
            make = lambda p=params: train(full_log(spark, sf_dir), p, NOW)
            model = trained(spark, sf_dir, mode, make)
        one = answer(spark, sf_dir, users(spark, sf_dir), params, model).withColumn("mode", F.lit(mode))
        found = one if found is None else found.unionByName(one)
    return found


QUERIES: dict[str, Query] = {
    "user_recs": user_recs,
    "history_cap": history_cap,
    "item_recs": item_recs,
    "item_set_recs": item_set_recs,
    "mixed_recs": mixed_recs,
    "event_name_override": event_name_override,
    "cross_recs": cross_recs,
    "popular_recs": popular_recs,
    "unknown_entity_fallback": unknown_entity_fallback,
    "term_match": term_match_query,
    "term_score": term_score_query,
    "bias_user": bias_user,
    "bias_item": bias_item,
    "bias_item_set": bias_item_set,
    "negative_bias_filter": negative_bias_filter,
    "field_boost": field_boost,
    "field_filter": field_filter,
    "field_exclude": field_exclude,
    "rule_defaults": rule_defaults,
    "date_rules": date_rules,
    "date_moments": date_moments,
    "narrow_rules": narrow_rules,
    "history_recs": history_recs,
    "backfill": backfill,
    "blacklist": blacklist,
    "exclude_items": exclude_items,
    "top_n": top_n,
    "paginate": paginate,
    "with_ranks": with_ranks,
    "recs_model_modes": recs_model_modes,
}
