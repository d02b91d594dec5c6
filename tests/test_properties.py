from datetime import datetime, timedelta

from pyspark.sql import functions as F

from likewise import EngineParams
from likewise.operators import events as ev
from likewise.operators import model as md
from likewise.operators import properties as pr
from likewise.plans.train import clean_events, present_events, train
from shop import SCHEMA

T = datetime(2024, 1, 1)


def plog(spark, *rows):
    """(event, item, properties, day) in order of arrival."""
    return spark.createDataFrame(
        [(e, "item", i, None, None, p, T + timedelta(days=d), n) for n, (e, i, p, d) in enumerate(rows)], SCHEMA
    )


def folded(df):
    return {r["item"]: r["props"] for r in pr.aggregate_properties(df).collect()}


def test_the_last_value_of_each_name_stays(spark):
    got = folded(plog(
        spark,
        ("$set", "x", {"a": ["1"], "b": ["1"]}, 0),
        ("$set", "x", {"a": ["2", "3"]}, 2),
        ("$set", "x", {"a": ["late arrival of old news"]}, 1),
    ))
    assert got == {"x": {"a": ["2", "3"], "b": ["1"]}}


def test_equal_times_are_settled_by_arrival(spark):
    got = folded(plog(spark, ("$set", "x", {"a": ["1"]}, 0), ("$set", "x", {"a": ["2"]}, 0)))
    assert got == {"x": {"a": ["2"]}}


def test_unset_removes_names_and_keeps_the_item(spark):
    got = folded(plog(
        spark,
        ("$set", "x", {"a": ["1"]}, 0),
        ("$unset", "x", {"a": []}, 1),
        ("$set", "y", {"a": ["1"], "b": ["1"]}, 0),
        ("$unset", "y", {"a": []}, 1),
        ("$unset", "z", {"a": []}, 1),
        ("$unset", "x", None, 3),
    ))
    assert got == {"x": {}, "y": {"b": ["1"]}}


def test_delete_removes_the_item_until_it_is_set_again(spark):
    got = folded(plog(
        spark,
        ("$set", "x", {"a": ["1"], "b": ["1"]}, 0),
        ("$delete", "x", None, 1),
        ("$set", "x", {"a": ["2"]}, 2),
        ("$set", "y", {"a": ["1"]}, 0),
        ("$delete", "y", None, 1),
        ("$set", "e", {}, 0),
    ))
    assert got == {"x": {"a": ["2"]}, "e": {}}


def test_compacting_changes_nothing(spark):
    log = plog(
        spark,
        ("$set", "x", {"a": ["1"], "b": ["1"]}, 0),
        ("$unset", "x", {"b": []}, 1),
        ("$set", "x", {"c": ["2"]}, 2),
        ("$set", "y", {"a": ["1"]}, 0),
        ("$delete", "y", None, 1),
    )
    compact = pr.compact_properties(log)
    assert compact.count() == 1
    again = compact.select(*[F.col(c) if c in compact.columns else F.lit(None).cast(t).alias(c) for c, t in log.dtypes])
    assert folded(again) == folded(log) == {"x": {"a": ["1"], "c": ["2"]}}


def test_types(spark):
    rows = [("x", n, v) for n, v in [
        ("day", "2024-02-03T04:05:06"), ("userRank", "7"), ("n", "-12"), ("f", "1.5e3"), ("t", "true"),
        ("s", "1.2.3"), ("day", "not a date"), ("z", "007"),
    ]]
    typed = pr.coerce_property_types(spark.createDataFrame(rows, "item string, field string, value string"), ["day"])
    got = [tuple(v for v in r[2:] if v is not None) for r in typed.collect()]
    assert got == [
        ("date", datetime(2024, 2, 3, 4, 5, 6)), ("double", 7.0), ("int", -12), ("double", 1500.0),
        ("bool", True), ("string", "1.2.3"), ("date",), ("string", "007"),
    ]


def test_merging_prefers_later_relations(spark):
    kind = f"item string, props {md.PROPS}"
    a = spark.createDataFrame([("x", {"p": ["1"], "q": ["1"]}), ("y", {"p": ["1"]})], kind)
    b = spark.createDataFrame([("x", {"q": ["2"]}), ("z", {})], kind)
    c = spark.createDataFrame([("x", {"q": ["3"], "r": ["3"]})], kind)
    got = {r["item"]: r["props"] for r in md.merge_model([a, b, c]).collect()}
    assert got == {"x": {"p": ["1"], "q": ["3"], "r": ["3"]}, "y": {"p": ["1"]}, "z": {}}


def test_a_ranking_overrides_the_property_of_its_name(spark):
    props = spark.createDataFrame([("x", {"popRank": ["9"], "a": ["1"]}), ("y", {"popRank": ["9"]})], f"item string, props {md.PROPS}")
    ranks = spark.createDataFrame([("x", 2.0), ("z", 1.0)], "item string, popRank double")
    got = {r["item"]: (r["props"], r["popRank"]) for r in md.join_props_ranks(props, ranks).collect()}
    assert got == {
        "x": ({"popRank": ["2.0"], "a": ["1"]}, 2.0), "y": ({"popRank": ["9"]}, None), "z": ({}, 1.0),
    }


def usage(spark, *rows):
    return spark.createDataFrame(
        [(e, "user", u, "item", i, None, T + timedelta(days=d), n) for n, (e, u, i, d) in enumerate(rows)], SCHEMA
    )


def test_window_and_deduplication(spark):
    log = usage(spark, ("a", "u", "x", 0), ("a", "u", "x", 3), ("b", "u", "x", 1), ("a", "u", "y", 9))
    assert {r.seq for r in ev.dedup_events(log).collect()} == {1, 2, 3}
    assert {r.seq for r in ev.moving_window(log, "6 days").collect()} == {1, 3}
    assert {r.seq for r in ev.moving_window(log, "6 days", T + timedelta(days=7)).collect()} == {1, 2, 3}


def said(spark, *rows):
    """Property events: (event, item, properties, day)."""
    return spark.createDataFrame(
        [(e, "item", i, None, None, p, T + timedelta(days=d), 100 + n) for n, (e, i, p, d) in enumerate(rows)], SCHEMA
    )


def test_cleaning_loses_no_property(spark):
    log = said(
        spark,
        ("$set", "x", {"color": ["red"]}, -400), ("$set", "x", {"size": ["1"]}, -399), ("$set", "x", {"size": ["1"]}, -398),
        ("$set", "y", {"a": ["1"]}, -9), ("$set", "y", {"a": ["2"]}, -8), ("$set", "y", {"a": ["1"]}, -7),
        ("$set", "z", {"a": ["1"]}, -9), ("$delete", "z", None, -8), ("$set", "w", {"a": ["1"], "b": ["2"]}, -3),
        ("$unset", "w", {"b": []}, -2),
    ).unionByName(usage(spark, ("a", "u", "x", 0), ("a", "u", "x", 3), ("a", "v", "x", -30)))
    want = {"x": {"color": ["red"], "size": ["1"]}, "y": {"a": ["1"]}, "w": {"a": ["1"]}}
    for window in (None, "6 days"):
        for dedup in (False, True):
            for compact in (False, True):
                params = EngineParams.of("a", event_window=window, dedup_events=dedup, compact_properties=compact)
                cleaned = clean_events(log, params)
                assert cleaned.columns == log.columns
                props = {r["item"]: r["props"] for r in pr.aggregate_properties(cleaned).collect()}
                assert props == want
                acts = cleaned.where("event = 'a'").count()
                assert acts == 3 - (window is not None) - dedup


def test_training_keeps_properties_and_finds_the_first_event_type(spark):
    log = usage(spark, *[("b", f"u{n % 5}", f"i{n % 3}", 0) for n in range(30)], ("b", "", "x", 0), ("b", "u", None, 0))
    log = log.unionByName(said(spark, ("$set", "i0", {"a": ["1"]}, -400), ("$set", "i0", {"b": ["2"]}, -300)))
    params = EngineParams.of("a", "b", event_window="6 days", dedup_events=True)
    model = train(log, params, T + timedelta(days=1))
    items = {r["item"]: r["props"] for r in model.items.collect()}
    assert "x" not in items and None not in items
    assert items["i0"]["a"] == ["1"] and items["i0"]["b"] == ["2"]
    assert {r.event for r in model.correlators.collect()} <= {"b"}
    assert present_events(log, params).primary == "b"


def test_properties_are_folded_in_one_pass(spark, tmp_path):
    said(spark, ("$set", "x", {"a": ["1"]}, 0)).write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    plan = pr.aggregate_properties(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_rejected_events_are_counted_not_fatal(spark):
    log = usage(spark, ("a", "u", "x", 0), ("q", "u", "x", 0), ("a", "", "x", 0), ("a", "u", None, 0), ("a", None, "x", 0))
    good, bad = ev.validate_events(log, ["a"])
    assert [r.seq for r in good.collect()] == [0]
    assert {r.seq: r.reason for r in bad.collect()} == {
        1: "unexpected event", 2: "empty user", 3: "empty item", 4: "empty user",
    }


def test_empty_event_types_are_dropped(spark):
    log = usage(spark, ("b", "u", "x", 0), ("c", "u", "x", 0)).selectExpr("event")
    got = ev.event_inventory(log, ["a", "b", "c"]).orderBy("position").collect()
    assert [(r.event, r.position) for r in got] == [("b", 1), ("c", 2)]


def test_a_small_file_of_many_items_is_folded_by_many_tasks(spark):
    """Events are dealt out before they become a row per property, which is sorted."""
    log = plog(spark, *[("$set", f"i{n}", {"a": ["1"], "b": [str(n)]}, 0) for n in range(200)]).coalesce(1)
    found = pr.aggregate_properties(log)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode") < text.index("RepartitionByExpression [item")
    assert folded(log) == {f"i{n}": {"a": ["1"], "b": [str(n)]} for n in range(200)}
