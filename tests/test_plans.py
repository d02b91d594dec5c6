"""What the physical plans must and must not contain."""

import pytest

from likewise import EngineParams, Indicator, Ranking
from likewise.operators import rankings as rk
from likewise.operators import similarity as sim
from likewise.plans.recommend import recommend
from likewise.plans.train import train
from likewise.sources.tables import scan_events, usage_events
from shop import EVENTS, NOW, event_log


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "events")
    event_log(spark).write.parquet(path)
    return spark.read.parquet(path)


def test_scans_read_only_what_is_asked(stored):
    text = plan(usage_events(stored, ["buy"]).select("user", "item"))
    pushed = text[text.index("PushedFilters") :]
    for condition in ("EqualTo(event,buy)", "EqualTo(entity_type,user)", "EqualTo(target_entity_type,item)"):
        assert condition in pushed or condition.replace("EqualTo", "In") in pushed
    assert "properties" not in text and "seq" not in text
    assert "EqualTo(entity_type,user)" in plan(scan_events(stored, EVENTS))


def test_pairs_are_combined_before_they_are_shuffled(stored):
    usage = usage_events(stored, EVENTS).select("user", "event", "item")
    text = plan(sim.correlators(usage, [Indicator(n) for n in EVENTS]))
    # after the pairs are generated: counted, shuffled on the whole triple, counted again,
    # cut to the best of each task, and only then shuffled on (item, event)
    above = text[: text.index("Generate explode")]
    triple = above.rindex("Exchange hashpartitioning(item")
    assert "partial_count(1)" in above[triple:] and "correlator" in above[triple : triple + 200]
    assert above.count("Exchange hashpartitioning") == 2
    assert "WindowGroupLimit" in above[above.index("Exchange hashpartitioning") : triple]
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text


def test_all_rankings_share_one_scan(stored, spark):
    props = spark.createDataFrame([("x", {})], "item string, props map<string,array<string>>")
    rankings = [Ranking(t, event_names=("buy",), duration="9 days") for t in ("popular", "trending", "hot")]
    text = plan(rk.rank_table(rankings, stored, props, NOW))
    assert text.count("FileScan") == 1 and "GreaterThanOrEqual(event_time" in text


def test_answers_need_no_cross_join(stored, spark):
    params = EngineParams.of(*EVENTS, num=5)
    model = train(stored, params, NOW)
    queries = stored.selectExpr("entity_id AS query_id", "entity_id AS user").distinct()
    text = plan(recommend(queries, model, stored, params, NOW))
    for operator in ("CartesianProduct", "NestedLoop", "Python"):
        assert operator not in text
