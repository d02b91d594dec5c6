"""From a table of queries to terms, exclusions and rules.

A batch is a DataFrame with one row per query. Only ``query_id`` is required; every
other column may be missing or NULL:

    user, item, item_set array, user_bias, item_bias, item_set_bias double,
    fields array<struct<name, values array<string>, bias double>>,
    current_date timestamp, date_range struct<name, before, after>,
    blacklist_items array, return_self boolean, num int, from int,
    event_names array<string>, with_ranks boolean
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from likewise.operators.groups import SHARDS, top_per_group
from likewise.params import EngineParams
from likewise.sources.staging import stage

RULES = "array<struct<name:string,values:array<string>,bias:double>>"
DATE_RANGE = "struct<name:string,before:timestamp,after:timestamp>"


def complete_queries(
    queries: DataFrame, params: EngineParams, user_type: DataType, item_type: DataType
) -> DataFrame:
    """All query columns, with the engine's parameters wherever a query is silent."""
    item = item_type.simpleString()
    columns = {
        "user": (user_type.simpleString(), None),
        "user_bias": ("double", F.lit(params.user_bias)),
        "item": (item, None),
        "item_bias": ("double", F.lit(params.item_bias)),
        "item_set": (f"array<{item}>", None),
        "item_set_bias": ("double", F.lit(1.0)),
        "fields": (RULES, None),
        "current_date": ("timestamp", None),
        "date_range": (DATE_RANGE, None),
        "blacklist_items": (f"array<{item}>", None),
        "return_self": ("boolean", F.lit(params.return_self)),
        "num": ("int", F.lit(params.num)),
        "from": ("int", F.lit(0)),
        "event_names": ("array<string>", F.array(*[F.lit(n) for n in params.event_names])),
        "with_ranks": ("boolean", F.lit(False)),
    }
    full = [F.col("query_id")]
    for name, (kind, default) in columns.items():
        given = F.col(f"`{name}`") if name in queries.columns else F.lit(None)
        value = given.cast(kind)
        full.append((value if default is None else F.coalesce(value, default)).alias(name))
    return queries.select(*full)


def _engine_rules(params: EngineParams) -> Column:
    rules = [
        F.struct(
            F.lit(r.name).alias("name"),
            F.array(*[F.lit(v) for v in r.values]).cast("array<string>").alias("values"),
            F.lit(float(r.bias)).alias("bias"),
        )
        for r in params.fields
    ]
    return F.array(*rules).cast(RULES)


def all_field_rules(queries: DataFrame, params: EngineParams) -> DataFrame:
    """Merges the engine's field rules into each query's own; equal ones count once."""
    own = F.coalesce("fields", F.array().cast(RULES))
    return queries.withColumn("fields", F.array_union(own, _engine_rules(params)))


# -- terms ------------------------------------------------------------------------


def recent_history(queries: DataFrame, usage: DataFrame, params: EngineParams) -> DataFrame:
    """(user, event, item, event_time): the events of the queried users.

    ``usage`` is (user, event, item, event_time). All of a user's events are used. Only an
    indicator with ``max_query_events`` keeps the newest of its type, repeats counted; a user
    holding a large share of the log is cut down in shards then.
    """
    asked = queries.select("user").where(F.col("user").isNotNull()).distinct()
    theirs = usage.where(F.col("event").isin(params.event_names)).join(asked, "user", "left_semi")
    theirs = theirs.select("user", "event", "item", "event_time")
    caps = {i.name: i.max_query_events for i in params.indicators if i.max_query_events}
    if not caps:
        return theirs
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    newest = top_per_group(
        theirs.where(F.col("event").isin(list(caps))),
        ["user", "event"],
        [F.col("event_time").desc(), F.col("item")],
        max(caps.values()),
        rank="place",
        shards=SHARDS,
    )
    newest = newest.where(F.col("place") <= cap[F.col("event")]).drop("place")
    return theirs.where(~F.col("event").isin(list(caps))).unionByName(newest)


def _bit(params: EngineParams, event: Column, offset: int) -> Column:
    """One bit per (kind of term, event type), for terms that must be matched."""
    bits = F.create_map(
        *[F.lit(x) for i, name in enumerate(params.event_names) for x in (name, 1 << (i + offset))]
    )
    return bits[event].cast("bigint")


def user_terms(queries: DataFrame, usage: DataFrame, params: EngineParams) -> DataFrame:
    """A user's recent targets, under the field of the event that led to them."""
    seen = recent_history(queries, usage, params).select("user", "event", "item").distinct()
    asking = queries.where(F.col("user").isNotNull()).select(
        "query_id", "sig", "user", "user_bias", "event_names"
    )
    return asking.join(seen, "user").where(F.array_contains("event_names", F.col("event"))).select(
        "query_id",
        "sig",
        F.col("event").alias("field"),
        F.col("item").cast("string").alias("term"),
        _boost("user_bias").alias("boost"),
        F.when(F.col("user_bias") < 0, _bit(params, F.col("event"), 0))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("bit"),
    )


def item_terms(queries: DataFrame, correlators: DataFrame, params: EngineParams) -> DataFrame:
    """An item's own correlators, strongest first up to the indicator's limit if it has one."""
    caps = {i.name: i.max_query_events for i in params.indicators if i.max_query_events}
    own = correlators.where(F.col("event").isin(params.event_names))
    if caps:
        cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
        own = own.where(F.col("rnk") <= F.coalesce(cap[F.col("event")], F.col("rnk")))
    own = own.select("item", "event", "correlator")
    asking = queries.where(F.col("item").isNotNull()).select("query_id", "sig", "item", "item_bias")
    # its true size decides whether the correlators, however many, are shuffled for it
    asking = stage(asking, "asking")
    return asking.join(own, "item").select(
        "query_id",
        "sig",
        F.col("event").alias("field"),
        F.col("correlator").cast("string").alias("term"),
        _boost("item_bias").alias("boost"),
        F.when(F.col("item_bias") < 0, _bit(params, F.col("event"), len(params.indicators)))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("bit"),
    )


def set_terms(queries: DataFrame, params: EngineParams) -> DataFrame:
    """The items of a cart, under the primary event; a bias of 0 drops them."""
    return (
        queries.where(F.col("item_set_bias") != 0)
        .select("query_id", "sig", "item_set_bias", F.explode("item_set").alias("member"))
        .select(
            "query_id",
            "sig",
            F.lit(params.primary).alias("field"),
            F.col("member").cast("string").alias("term"),
            _boost("item_set_bias").alias("boost"),
            F.lit(0).cast("bigint").alias("bit"),
        )
        .distinct()
    )


def boost_terms(queries: DataFrame) -> DataFrame:
    """Values of field rules with a positive bias, as boosted terms."""
    return (
        queries.select("query_id", "sig", F.explode("fields").alias("rule"))
        .where(F.col("rule.bias") > 0)
        .select(
            "query_id",
            "sig",
            F.col("rule.name").alias("field"),
            F.explode(F.array_distinct("rule.values")).alias("term"),
            F.col("rule.bias").alias("boost"),
            F.lit(0).cast("bigint").alias("bit"),
        )
    )


def _boost(bias: str) -> Column:
    """A positive bias multiplies; 0 means no boost; a negative one filters, unscored."""
    return (
        F.when(F.col(bias) < 0, F.lit(0.0))
        .when(F.col(bias) == 0, F.lit(1.0))
        .otherwise(F.col(bias))
    )


def query_terms(
    queries: DataFrame, usage: DataFrame, correlators: DataFrame, params: EngineParams
) -> DataFrame:
    """(query_id, sig, field, term, boost, bit): what the queries' histories, items and carts match.

    Boosts of correlators are among them; those of properties are ``boosting.query_boosts``.
    """
    return (
        user_terms(queries, usage, params)
        .unionByName(item_terms(queries, correlators, params))
        .unionByName(set_terms(queries, params))
        .unionByName(boost_terms(queries).where(F.col("field").isin(params.event_names)))
    )


# -- exclusions -------------------------------------------------------------------


def exclusions(queries: DataFrame, usage: DataFrame, params: EngineParams) -> DataFrame:
    """(query_id, sig, item): what a query must not return.

    The user's targets of the blacklisting events (whatever event types the query uses
    as history), the query's own list, its item unless ``return_self``, and its cart.
    """
    none = F.array().cast(queries.schema["item_set"].dataType)
    own = F.when(F.col("item").isNotNull() & ~F.col("return_self"), F.array("item"))
    listed = [F.coalesce(c, none) for c in (F.col("blacklist_items"), F.col("item_set"), own)]
    lists = queries.select("query_id", "sig", F.explode(F.concat(*listed)).alias("item"))
    names = params.blacklisting_events
    if names:
        asking = queries.where(F.col("user").isNotNull()).select("query_id", "sig", "user")
        theirs = usage.where(F.col("event").isin(names)).join(
            asking.select("user").distinct(), "user", "left_semi"
        )
        # distinct on one struct: its own shuffle, combined beforehand, instead of the
        # join's partitioning by user, in which a hot user is a single task
        had = theirs.select(F.struct("user", "item").alias("had")).distinct().select("had.*")
        lists = lists.unionByName(asking.join(had, "user").select("query_id", "sig", "item"))
    return lists.where(F.col("item").isNotNull()).distinct()


# -- rules ------------------------------------------------------------------------


def with_rules(queries: DataFrame, params: EngineParams, now: Column) -> DataFrame:
    """Adds the columns deciding which items a query may return at all.

    ``rules`` is their text, NULL for a query without any. ``required`` has a bit per
    event type whose terms must be matched (negative bias).
    """
    rule = "array<struct<name:string,values:array<string>>>"
    bare = {
        "filters": F.filter("fields", lambda r: r["bias"] < 0),
        "excludes": F.filter("fields", lambda r: r["bias"] == 0),
    }
    ranged = F.col("date_range.after").isNotNull() | F.col("date_range.before").isNotNull()
    window = params.available_date_name and params.expire_date_name
    moment = F.coalesce("current_date", now).cast("timestamp") if window else F.lit(None)
    all_bits = (1 << len(params.indicators)) - 1
    wanted_bits = F.aggregate(
        F.transform("event_names", lambda n: F.coalesce(_bit(params, n, 0), F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda a, b: a.bitwiseOR(b),
    )
    ruled = queries.select(
        "*",
        *[
            F.array_sort(
                F.transform(
                    c, lambda r: F.struct(r["name"].alias("name"), F.array_sort(r["values"]).alias("values"))
                )
            )
            .cast(rule)
            .alias(n)
            for n, c in bare.items()
        ],
        F.when(ranged, F.col("date_range.name")).alias("date_name"),
        F.when(ranged, F.col("date_range.after")).alias("after"),
        F.when(ranged, F.col("date_range.before")).alias("before"),
        F.when(~F.coalesce(ranged, F.lit(False)), moment).cast("timestamp").alias("now"),
        F.when(F.col("user").isNotNull() & (F.col("user_bias") < 0), wanted_bits)
        .otherwise(F.lit(0).cast("bigint"))
        .bitwiseOR(
            F.when(
                F.col("item").isNotNull() & (F.col("item_bias") < 0),
                F.lit(all_bits << len(params.indicators)).cast("bigint"),
            ).otherwise(F.lit(0).cast("bigint"))
        )
        .alias("required"),
    )
    free = (
        (F.size("filters") == 0)
        & (F.size("excludes") == 0)
        & F.col("date_name").isNull()
        & F.col("now").isNull()
        & (F.col("required") == 0)
    )
    return ruled.withColumn("rules", rule_text(~free))


def rule_text(ruled: Column) -> Column:
    """What tells rule sets apart, where a query has one."""
    return F.when(ruled, F.to_json(F.struct(*RULE_COLUMNS)))


RULE_COLUMNS = ["filters", "excludes", "date_name", "after", "before", "now", "required"]


def number_signatures(asked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(queries with ``sig``, rule sets by ``sig``): equal rule sets share a number.

    0 stands for no rules. Where no query has any, there is no second table.
    """
    ruled = asked.where(F.col("rules").isNotNull())
    if ruled.isEmpty():
        return asked.withColumn("sig", F.lit(0).cast("bigint")), None
    sets = ruled.groupBy("rules").agg(*[F.any_value(c).alias(c) for c in RULE_COLUMNS])
    sets = stage(sets.withColumn("sig", F.monotonically_increasing_id() + 1), "signatures")
    numbered = ruled.join(sets.select("rules", "sig"), "rules").select(*asked.columns, "sig")
    # queries without rules stay out of the join, in which they would all be one NULL key
    free = asked.where(F.col("rules").isNull()).withColumn("sig", F.lit(0).cast("bigint"))
    return free.unionByName(numbered), sets


def field_rules_pass(props: Column, filters: Column, excludes: Column) -> Column:
    """Every inclusion rule finds a value of its own, no exclusion rule does."""

    def has(rule: Column) -> Column:
        return F.coalesce(F.arrays_overlap(props[rule["name"]], rule["values"]), F.lit(False))

    return F.forall(filters, has) & ~F.exists(excludes, has)


def date_rules_pass(params: EngineParams) -> Column:
    """Strictly inside the query's date range, or available now and not yet expired.

    An item without the date fails, as does a range over a name that is no date.
    """
    date = F.coalesce(
        *[F.when(F.col("date_name") == d, F.col(d)) for d in params.date_columns],
        F.lit(None).cast("timestamp"),
    )
    inside = (
        date.isNotNull()
        & F.coalesce(date > F.col("after"), F.lit(True))
        & F.coalesce(date < F.col("before"), F.lit(True))
    )
    verdict = F.when(F.col("date_name").isNotNull(), inside)
    if params.available_date_name and params.expire_date_name:
        open_now = (F.col(params.available_date_name) <= F.col("now")) & (
            F.col("now") < F.col(params.expire_date_name)
        )
        verdict = verdict.when(F.col("now").isNotNull(), F.coalesce(open_now, F.lit(False)))
    return verdict.otherwise(F.lit(True))


def rules_pass(params: EngineParams) -> Column:
    """The whole rule set of a signature against an item row joined to it."""
    fields = field_rules_pass(F.col("props"), F.col("filters"), F.col("excludes"))
    return fields & date_rules_pass(params)
