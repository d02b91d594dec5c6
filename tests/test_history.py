"""Histories by user, counts by stretches of time, postings of hot terms."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from likewise import EngineParams, Ranking
from likewise.operators import model as md
from likewise.operators import rankings as rk
from likewise.operators.stretches import Measure, StretchCounts
from likewise.plans.recommend import histories, recommend
from likewise.plans.train import refresh_ranks, train
from likewise.sources import history as hs
from shop import BOOKS, EVENTS, NOW, READERS, event_log

PARAMS = EngineParams.of(*EVENTS, num=5, blacklist_events=("browse",))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def answers(found):
    return sorted((r.query_id, r.pos, r.item, r.score) for r in found.collect())


@pytest.mark.parametrize("few", [200, 2])
def test_answers_from_a_history_are_those_from_the_log(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(hs, "FEW", few)
    log = event_log(spark)
    model = train(log, PARAMS, NOW)
    half = F.col("seq") % 2 == 0
    hs.write_history(log.where(half), EVENTS, str(tmp_path / "h"), buckets=8)
    history = hs.write_history(log.where(~half), EVENTS, str(tmp_path / "h"), buckets=8, append=True)
    asked = spark.createDataFrame([(u, u) for u in READERS] + [("n", None), ("x", "nobody")], "query_id string, user string")
    assert answers(recommend(asked, model, history, PARAMS, NOW)) == answers(recommend(asked, model, log, PARAMS, NOW))
    assert history.event_names() == set(EVENTS)


def test_one_query_reads_one_bucket_once(spark, tmp_path):
    history = hs.write_history(event_log(spark), EVENTS, str(tmp_path / "h"), buckets=64)
    users = spark.createDataFrame([(READERS[0],)], "user string")
    rows = history.of(users, ["buy", "browse"])
    text = plan(rows)
    assert text.count("FileScan") == 1 and "Exchange" not in text
    partition, pushed = (text[text.index(x) :].split("\n")[0] for x in ("PartitionFilters: [", "PushedFilters: ["))
    assert "(bucket#" in partition and f"EqualTo(user,{READERS[0]})" in pushed
    read = rows.select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("bucket=")[1].split("/")[0] for r in read}) == 1
    assert {r.user for r in rows.collect()} == {READERS[0]}


def test_the_log_is_scanned_once_for_terms_and_exclusions(spark, tmp_path):
    path = str(tmp_path / "log")
    event_log(spark).write.parquet(path)
    log = spark.read.parquet(path)
    asked = spark.createDataFrame([("q", READERS[0])], "query_id string, user string")
    found = histories(asked, log, PARAMS)
    assert {r.user for r in found.collect()} == {READERS[0]}
    model = train(log, PARAMS, NOW)
    assert path not in plan(recommend(asked, model, log, PARAMS, NOW))


def timed_log(spark, n=900, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        at = NOW - timedelta(seconds=rng.randrange(1, 40 * 86_400), microseconds=rng.randrange(10**6))
        rows.append((rng.choice(EVENTS), "user", f"u{k % 9}", "item", rng.choice([*BOOKS, None]), None, at, k))
    return spark.createDataFrame(rows, event_log(spark).schema)


RANKINGS = [
    Ranking("popular", event_names=("buy",), duration="17 days"),
    Ranking("trending", event_names=("buy", "browse"), duration="9 days"),
    Ranking("hot", duration="30 days"),
    Ranking("random", duration="11 hours"),
]


@pytest.mark.parametrize("seconds", [3600, 86_400, 40 * 86_400])
def test_ranks_from_stretches_are_those_of_a_full_scan(spark, tmp_path, seconds):
    log = timed_log(spark)
    props = spark.createDataFrame([("book 01", {})], "item string, props map<string,array<string>>")
    stored = StretchCounts(spark, str(tmp_path / "s"), seconds)
    for days in (20, 8, 8, 1):
        upto = NOW - timedelta(days=days, minutes=17)
        stored.update(log, upto)
        for end in (NOW, upto, upto - timedelta(hours=5, seconds=3)):
            full = rk.rank_table(RANKINGS, log, props, end)
            short = rk.rank_table(RANKINGS, log, props, end, stored=stored)
            assert sorted(map(tuple, short.collect())) == sorted(map(tuple, full.collect()))


def test_what_is_counted_is_not_read_again(spark, tmp_path):
    """The log keeps only what is new and the edges; the ranks stay."""
    log = timed_log(spark)
    params = EngineParams.of(*EVENTS, rankings=(Ranking("popular", event_names=("buy",), duration="20 days"),))
    model = train(log, params, NOW)
    stored = StretchCounts(spark, str(tmp_path / "s"), 3600)
    stored.update(log, NOW - timedelta(days=3))
    lo, hi = stored.covered()
    edge = NOW - timedelta(days=20)
    rest = log.where((F.col("event_time") >= hi) | F.col("event_time").between(edge - timedelta(hours=1), edge + timedelta(hours=1)))
    assert lo < edge < hi and rest.count() < log.count() / 2
    fresh = refresh_ranks(model, rest, params, NOW, stored)
    want = refresh_ranks(model, log, params, NOW)
    rows = lambda m: {(r["item"], r["popRank"], r["pos"]) for r in m.items.collect()}
    assert rows(fresh) == rows(want) and stored.covered()[1] == NOW
    with pytest.raises(ValueError):
        refresh_ranks(model, log, replace(params, dedup_events=True), NOW, stored)


def test_an_unfinished_stretch_is_counted_again(spark, tmp_path):
    log = timed_log(spark, 50)
    stored = StretchCounts(spark, str(tmp_path / "s"), 3600)
    m = [Measure("n", None, NOW - timedelta(days=30), NOW)]
    want = sorted(map(tuple, stored.counts(log, m).collect()))
    assert stored.covered() is None
    stored.update(log, NOW - timedelta(days=10))
    name = next((tmp_path / "s").iterdir())
    (name / "_SUCCESS").unlink()
    assert stored.covered() is None and sorted(map(tuple, stored.counts(log, m).collect())) == want
    stored.update(log, NOW - timedelta(days=10))
    assert sorted(map(tuple, stored.counts(log, m).collect())) == want


def test_a_value_that_half_the_catalog_has_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        items = spark.range(40_000).repartition(8).select(
            F.concat(F.lit("i"), F.col("id")).alias("item"), (F.col("id") + 1).alias("pos"),
            F.create_map(
                F.lit("kind"), F.array(F.when(F.col("id") % 2 == 0, "common").otherwise(F.concat(F.lit("k"), F.col("id"))))
            ).alias("props"),
        )
        entries = md.index_terms(None, items.select("item", "props"))
        weights = md.term_weights(entries, None, items.select("item", "props"))
        weighted = md._weighted(entries, weights)
        parts = weighted.where("term = 'common'").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 8 and max(r["count"] for r in parts) < 4_000
        postings = md.build_postings(entries, weights, items)
        sizes = postings.select("term", F.size("places").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        rows = {r.term: (r.n, r.most) for r in sizes.collect()}
        assert rows.pop("common")[0] == 20_000 and set(rows.values()) == {(1, 1)} and len(rows) == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
