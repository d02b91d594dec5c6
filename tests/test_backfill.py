"""Filling up: places against plain loops, and fills that no shuffle moves."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from likewise import EngineParams
from likewise.operators import backfill as bf
from likewise.operators.model import Model
from likewise.plans.recommend import recommend

N = 40
PARAMS = EngineParams.of("buy", num=5)
EVENT = (
    "event string, entity_type string, entity_id string, target_entity_type string, target_entity_id string, "
    "properties map<string,array<string>>, event_time timestamp, seq long"
)


@pytest.fixture(scope="module")
def catalog(spark):
    """A model of a ranking alone: item i01 is first."""
    rows = [(f"i{n:02d}", {"odd": [str(n % 2)]}, float(N - n), n) for n in range(1, N + 1)]
    items = spark.createDataFrame(rows, "item string, props map<string,array<string>>, popRank double, pos long")
    correlators = spark.createDataFrame([], "item string, event string, correlator string, llr double, rnk int")
    odd = [("odd", v, 1.0, 0, [n for n in range(1, N + 1) if n % 2 == int(v)]) for v in "01"]
    postings = spark.createDataFrame(odd, "field string, term string, idf double, block long, places array<long>")
    weights = postings.select("field", "term", F.lit(N // 2).cast("bigint").alias("df"), "idf")
    return Model(correlators, items, postings, weights)


def asked(spark):
    rows = [("none", None, 7), ("first", [1, 2, 3, 4, 5, 6, 7, 8, 9], 3), ("spread", [2, 2, 5, 11, 40], 30),
            ("all", list(range(1, N + 1)), 9), ("more", [3], 99)]
    named = [(q, None if out is None else [f"i{n:02d}" for n in out], num) for q, out, num in rows]
    return rows, spark.createDataFrame(named, "query_id string, blacklist_items array<string>, num int")


def log(spark):
    return spark.createDataFrame([("buy", "user", "u", "item", "i01", None, datetime(2024, 1, 1), 0)], EVENT)


def moves(plan, above=()):
    """For every explode, the shuffles, sorts and windows above it."""
    name = plan.nodeName()
    if name == "Generate":
        yield [x for x in above if x in ("Exchange", "Sort", "Window")]
    for i in range(plan.children().size()):
        yield from moves(plan.children().apply(i), (*above, name))


@pytest.mark.parametrize("ruled", [False, True])
@pytest.mark.parametrize("page", [4, 256])
def test_fills_are_the_best_places_not_taken(spark, catalog, monkeypatch, ruled, page):
    monkeypatch.setattr(bf, "PAGE", page)
    rows, queries = asked(spark)
    if ruled:
        rule = F.struct(F.lit("odd").alias("name"), F.array(F.lit("1")).alias("values"), F.lit(-1.0).alias("bias"))
        queries = queries.withColumn("fields", F.array(rule))
    got = recommend(queries, catalog, log(spark), PARAMS, "2024-01-31T00:00:00").collect()
    found = {q: [r.item for r in sorted(got, key=lambda r: r.pos) if r.query_id == q] for q, _, _ in rows}
    for q, out, num in rows:
        left = [n for n in range(1, N + 1) if n not in (out or []) and (not ruled or n % 2)]
        assert found[q] == [f"i{n:02d}" for n in left[:num]]
        assert sorted(r.pos for r in got if r.query_id == q) == list(range(1, len(found[q]) + 1))


def test_fills_are_not_shuffled(spark, catalog):
    """A page becomes its fills after the last shuffle, items' names included."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = recommend(asked(spark)[1], catalog, log(spark), PARAMS, "2024-01-31T00:00:00")
        plan = found._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [] in moves(plan)
