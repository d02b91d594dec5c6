from datetime import datetime, timedelta

import pytest

from likewise import Ranking
from likewise.functions.times import duration
from likewise.operators import rankings as rk
from shop import SCHEMA

START = datetime(2024, 1, 1)
END = START + timedelta(hours=30)


def log(spark, counts, per_slot_hours=10):
    """counts: item -> events per slot of ten hours."""
    rows = []
    for item, slots in counts.items():
        for slot, n in enumerate(slots):
            at = START + timedelta(hours=per_slot_hours * slot + 1)
            rows += [("a", "user", "u", "item", item, None, at, len(rows))] * n
    rows.append(("other", "user", "u", "item", "x", None, START, 0))
    rows.append(("a", "user", "u", "item", "x", None, END, 0))
    rows.append(("a", "user", "u", None, None, None, START, 0))
    return spark.createDataFrame(rows, SCHEMA)


def values(df):
    return {r["item"]: r["rank"] for r in df.collect()}


def test_popular_counts_repeats_inside_the_window(spark):
    got = rk.rank_popular(log(spark, {"x": [2, 0, 1], "y": [0, 0, 5]}), ["a"], START, END)
    assert values(got) == {"x": 3.0, "y": 5.0}


def test_trending_needs_both_halves(spark):
    counts = {"x": [4, 0, 1], "y": [1, 0, 5], "only new": [0, 0, 9], "only old": [9, 0, 0]}
    assert values(rk.rank_trending(log(spark, counts), ["a"], START, END)) == {"x": -3.0, "y": 4.0}


def test_hot_needs_all_three_thirds(spark):
    counts = {"x": [1, 2, 7], "y": [5, 2, 1], "gap": [3, 0, 3]}
    assert values(rk.rank_hot(log(spark, counts), ["a"], START, END)) == {"x": 4.0, "y": 2.0}


def test_random_repeats_and_covers_events_and_catalog(spark):
    props = spark.createDataFrame([("p", {}), ("x", {})], "item string, props map<string,array<string>>")
    events = log(spark, {"x": [1], "y": [1]})
    one = values(rk.rank_random(events, props, START, END, 5))
    assert set(one) == {"p", "x", "y"} and all(0 <= v < 1 for v in one.values())
    assert one == values(rk.rank_random(events.repartition(5), props, START, END, 5))
    assert one != values(rk.rank_random(events, props, START, END, 6))


def test_table_joins_all_and_may_be_limited_to_the_catalog(spark):
    props = spark.createDataFrame([("y", {"userRank": ["2.5"]}), ("p", {"userRank": ["no"]})], "item string, props map<string,array<string>>")
    rankings = [Ranking("popular", event_names=("a",), duration="30 hours"), Ranking("userDefined")]
    events = log(spark, {"x": [2], "y": [1]})
    got = {r["item"]: (r.popRank, r.userRank) for r in rk.rank_table(rankings, events, props, END).collect()}
    assert got == {"x": (2.0, None), "y": (1.0, 2.5)}
    only = rk.rank_table(rankings, events, props, END, catalog_only=True).collect()
    assert [r["item"] for r in only] == ["y"]


@pytest.mark.parametrize("text, seconds", [
    ("3650 days", 3650 * 86400), ("1 hour", 3600), ("90s", 90), ("2 min", 120), ("1500 ms", 1),
])
def test_durations(text, seconds):
    assert duration(text) == timedelta(seconds=seconds)


@pytest.mark.parametrize("text", ["", "days", "5", "3 weeks", "-1 days"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        duration(text)
