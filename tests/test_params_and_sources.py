from datetime import datetime

import pytest
from pyspark.sql import functions as F

from likewise import EngineParams, Ranking
from likewise.sources.delimited import (
    default_ranks,
    parse_delimited_events,
    parse_ratings,
    rejected_lines,
)
from likewise.sources.tables import scan_events


def test_an_engine_configuration_is_read(spark):
    params = EngineParams.from_config({
        "datasource": {"params": {"minEventsPerUser": 3, "eventWindow": {"duration": "90 days", "removeDuplicates": True}}},
        "algorithms": [{"params": {
            "indicators": [{"name": "buy"}, {"name": "view", "maxCorrelatorsPerItem": 7, "minLLR": 2.5, "maxItemsPerUser": 40}],
            "num": 4, "availableDateName": "from", "expireDateName": "till", "blacklistEvents": [],
            "fields": [{"name": "genre", "values": ["x"], "bias": -1}], "recsModel": "all", "userBias": 2.0,
            "rankings": [{"type": "hot", "duration": "3 days"}, {"type": "hot", "name": "again"}, {"type": "random"}],
        }}],
    })
    assert params.event_names == ["buy", "view"] and params.primary == "buy"
    buy, view = params.indicators
    assert (buy.max_items_per_user, buy.max_correlators, buy.min_llr) == (None, 50, None)
    assert (view.max_items_per_user, view.max_correlators, view.min_llr, view.max_query_events) == (40, 7, 2.5, 40)
    assert params.blacklisting_events == [] and params.num == 4 and params.user_bias == 2.0
    assert params.rank_columns == ["hotRank", "uniqueRank"]
    assert params.active_rankings[0].event_names == ("buy",)
    assert params.date_columns == ["from", "till"]
    assert (params.event_window, params.dedup_events, params.min_events_per_user) == ("90 days", True, 3)


def test_defaults_of_the_short_form():
    params = EngineParams.from_config({"algorithms": [{"params": {"eventNames": ["a", "b"]}}]})
    assert params == EngineParams.of("a", "b")
    assert params.num == 20 and params.blacklisting_events == ["a"]
    assert [i.max_query_events for i in params.indicators] == [None, None]
    assert params.rank_columns == ["popRank"] and params.active_rankings[0].duration == "3650 days"


def test_mistakes_are_named():
    with pytest.raises(ValueError, match="event type"):
        EngineParams(())
    with pytest.raises(ValueError, match="recs_model"):
        EngineParams.of("a", recs_model="best")
    with pytest.raises(ValueError, match="ranking type"):
        Ranking("popularity")


def lines(spark, *text):
    return spark.createDataFrame(list(enumerate(text)), "seq long, value string")


def test_delimited_lines(spark):
    parsed = parse_delimited_events(
        lines(spark, "u 1,buy,Thing-A", "Thing-A,$set,kind:x:y z", "Thing-A,$set,defaultRank:2.5\r", "", "short,line"),
        F.lit("2024-01-01").cast("timestamp"),
    ).orderBy("seq")
    got = parsed.collect()
    assert [(r.event, r.entity_type, r.entity_id, r.target_entity_id, r.properties) for r in got] == [
        ("buy", "user", "u 1", "Thing-A", None),
        ("$set", "item", "Thing-A", None, {"kind": ["x", "y z"]}),
        ("$set", "item", "Thing-A", None, {"defaultRank": ["2.5"]}),
    ]
    assert got[0].event_time == datetime(2024, 1, 1)
    assert [tuple(r) for r in default_ranks(parsed).collect()] == [("Thing-A", 2.5)]
    assert scan_events(parsed, ["buy"]).count() == 1


def test_ratings(spark):
    text = [f"{n % 7}::{n % 11}::{n % 5 + 1}" for n in range(200)]
    lists = [["maps"], ["maps", "globes"], ["tales"]]
    got = parse_ratings(lines(spark, *text), seed=1, categories=lists)
    kinds = {r.event: r["count"] for r in got.groupBy("event").count().collect()}
    assert kinds["$set"] == 200 and kinds["buy"] + kinds["rate"] == 200 and min(kinds.values()) > 50
    pairs = {tuple(r.properties["category"]) for r in got.where("event = '$set'").collect()}
    assert pairs == {tuple(x) for x in lists}
    assert parse_ratings(lines(spark, *text)).where("event = '$set'").isEmpty()
    again = parse_ratings(lines(spark, *text).repartition(5), seed=1, categories=lists)
    flat = ["event", "entity_id", F.to_json("properties"), "seq"]
    assert got.select(*flat).exceptAll(again.select(*flat)).isEmpty()


def test_short_lines_are_reported(spark):
    lines = spark.createDataFrame([("u,buy,x", 0), ("u,buy", 1), ("", 2), (None, 3)], "value string, seq long")
    assert [r.seq for r in parse_delimited_events(lines).collect()] == [0]
    got = {r.seq: r.reason for r in rejected_lines(lines, ",", 3).collect()}
    assert got == {1: "found 2 of 3 parts", 2: "found 1 of 3 parts", 3: "no text"}
