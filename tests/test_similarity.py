import random

import pytest
from pyspark.sql import functions as F

import brute
from likewise import Indicator
from likewise.operators import events as ev
from likewise.operators import similarity as sim


def log(seed, users=30, items=25, n=500, hot=False):
    """With ``hot``, a third of all events is one user's and a third is one item's."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        u, e, i = rng.randrange(users), rng.choice("abc"), rng.randrange(items)
        if hot and rng.random() < 0.33:
            u, i = 0, rng.randrange(items * 8)
        elif hot and rng.random() < 0.5:
            u, i = rng.randrange(users * 8), 3
        rows.append((f"u{u}", e, f"i{i}"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "user string, event string, item string")


def as_lists(df):
    lists = {}
    for r in df.orderBy("item", "event", "rnk").collect():
        lists.setdefault((r.item, r.event), []).append((r.correlator, r.llr))
    return lists


@pytest.mark.parametrize(
    "hot, limits",
    [
        (False, {}),
        (False, {"min_events": 6}),
        (True, {"cap": 6, "seed": 3}),
        (True, {"cap": 4, "seed": 3, "min_events": 5}),
    ],
)
def test_correlators_equal_plain_loops(spark, hot, limits):
    rows = log(1, hot=hot)
    names = ["b", "a", "c"]
    indicators = [Indicator(n, limits.get("cap"), 5) for n in names]
    got = sim.correlators(
        frame(spark, rows), indicators, limits.get("min_events"), limits.get("seed", 0)
    )
    assert as_lists(got) == brute.correlators(rows, names, k=5, **limits)


def test_prepared_groups_are_bounded_by_the_caps(spark):
    rows = log(2, hot=True)
    cut, _ = ev.prepare(frame(spark, rows), [Indicator(n, 5) for n in "abc"])
    assert cut.groupBy("user", "event").count().agg(F.max("count")).first()[0] <= 5
    assert cut.groupBy("event", "item").count().agg(F.max("count")).first()[0] <= 5


def test_nothing_is_cut_unasked(spark):
    """One item holds a third of the log, one user has 1,500 items, in small and large blocks."""
    rng = random.Random(9)
    rows = [(f"u{n}", rng.choice("ab"), "hot") for n in range(900)]
    rows += [("busy", rng.choice("ab"), f"i{n}") for n in range(1500)]
    rows += [(f"u{rng.randrange(900)}", rng.choice("ab"), f"i{rng.randrange(40)}") for _ in range(900)]
    got = sim.correlators(frame(spark, rows), [Indicator("a"), Indicator("b")])
    assert as_lists(got) == brute.correlators(rows, ["a", "b"])
    kept, _ = ev.prepare(frame(spark, rows), [Indicator("a"), Indicator("b")])
    assert {tuple(r) for r in kept.select("user", "event", "item").collect()} == brute.prepare(rows, ["a", "b"])[0]


def test_blocks_of_a_basket_meet_each_other(spark, monkeypatch):
    rows = log(11)
    want = as_lists(sim.correlators(frame(spark, rows), [Indicator(n) for n in "abc"]))
    monkeypatch.setattr(sim, "BASKET", 3)
    assert as_lists(sim.correlators(frame(spark, rows), [Indicator(n) for n in "abc"])) == want


def test_n_users_is_the_margin(spark):
    cut, _ = ev.prepare(frame(spark, log(2, hot=True)), [Indicator(n, 5) for n in "abc"])
    wrong = (
        cut.groupBy("event", "item")
        .agg(F.count("*").alias("n"), F.min("n_users").alias("lo"), F.max("n_users").alias("hi"))
        .where("n <> lo OR n <> hi")
    )
    assert wrong.isEmpty()


def test_cooccurrence_is_symmetric_and_without_self_pairs(spark):
    cut, _ = ev.prepare(frame(spark, log(5)), [Indicator(n) for n in "abc"])
    found = {(r.item, r.correlator): r.n_both for r in sim.cooccurrence_counts(cut, "a").collect()}
    assert found and all(found[j, i] == n for (i, j), n in found.items())
    assert all(i != j for i, j in found)


def test_cross_occurrence_keeps_same_id_pairs(spark):
    rows = [("u", "a", "x"), ("u", "b", "x"), ("v", "a", "y")]
    cut, _ = ev.prepare(frame(spark, rows), [Indicator(n) for n in "ab"])
    got = [tuple(r) for r in sim.cross_occurrence_counts(cut, "a").collect()]
    assert got == [("x", "b", "x", 1)]


def test_llr_is_never_negative_and_zero_at_independence(spark):
    # 2 of 4 users have x, 2 of 4 have y, 1 has both: independent
    rows = [("1", "a", "x"), ("2", "a", "x"), ("2", "a", "y"), ("3", "a", "y"), ("4", "a", "z")]
    cut, users = ev.prepare(frame(spark, rows), [Indicator("a")])
    scored = sim.llr_scores(sim.pair_counts(cut, "a"), users)
    assert scored.where("llr < 0").isEmpty()
    assert scored.where("item = 'x' AND correlator = 'y' AND llr <> 0").isEmpty()
    assert sim.llr_threshold(scored).where("item = 'x' AND correlator = 'y'").isEmpty()


def test_limits_per_indicator(spark):
    rows = log(7)
    plain = as_lists(sim.correlators(frame(spark, rows), [Indicator(n) for n in "abc"]))
    limits = [Indicator("a", max_correlators=2), Indicator("b", min_llr=1.5), Indicator("c")]
    limited = as_lists(sim.correlators(frame(spark, rows), limits))
    for (item, event), full in plain.items():
        want = full[:2] if event == "a" else [x for x in full if event == "c" or x[1] >= 1.5]
        assert limited.get((item, event), []) == want


def test_lists_keep_the_order(spark):
    found = sim.correlators(frame(spark, log(8)), [Indicator(n) for n in "ab"])
    want = {k: [c for c, _ in v] for k, v in as_lists(found).items()}
    got = {(r.item, r.event): r.correlators for r in sim.correlator_lists(found).collect()}
    assert got == want


def test_min_events_counts_repeats(spark):
    rows = [("u", "a", "x")] * 3 + [("v", "a", "x"), ("v", "a", "y"), ("u", "b", "q")]
    got = ev.min_events_filter(frame(spark, rows), "a", 3).collect()
    assert [tuple(r) for r in got] == [("u", "a", "x")]


def test_secondary_users_need_a_primary_event(spark):
    rows = [("u", "a", "x"), ("u", "b", "p"), ("v", "b", "q")]
    got = ev.restrict_secondary_users(frame(spark, rows), "a").collect()
    assert [r.item for r in got] == ["p"]


def test_light_items_meet_lists_and_common_ones_pairs(spark, monkeypatch):
    rows = log(12, hot=True)
    cut = ev.prepare(frame(spark, rows), [Indicator(n) for n in "abc"])[0].localCheckpoint()
    had = {}
    for user, event, item in {tuple(r) for r in cut.select("user", "event", "item").collect()}:
        had.setdefault(user, []).append((event, item))
    want = {}
    for acts in had.values():
        for item in (i for e, i in acts if e == "a"):
            for e, c in acts:
                if (e, c) != ("a", item):
                    want[item, e, c] = want.get((item, e, c), 0) + 1
    monkeypatch.setattr(sim, "BASKET", 3)
    for light in (0, 4, 1000):
        monkeypatch.setattr(sim, "LIGHT", light)
        found = sim.pair_counts(cut, "a")
        assert {(r.item, r.event, r.correlator): r.n_both for r in found.collect()} == want
        cross = {(r.item, r.event, r.correlator): r.n_both for r in sim.cross_occurrence_counts(cut, "a").collect()}
        assert cross == {k: n for k, n in want.items() if k[1] != "a"}


def test_pairs_of_light_items_are_not_shuffled(spark):
    """What is shuffled for them is a list per user and item, not a row per pair."""
    rows = [(f"u{u}", e, f"{e}{u}-{k}") for u in range(20) for e in "ab" for k in range(20)]
    cut, _ = ev.prepare(frame(spark, rows), [Indicator(n) for n in "ab"])
    text = sim.pair_counts(cut, "a")._jdf.queryExecution().optimizedPlan().toString()
    light = text[text.rindex("Aggregate [item") :]
    # the lists are dealt by item below what makes pairs of them
    assert light.index("arrays_zip") < light.index("RepartitionByExpression [item")
