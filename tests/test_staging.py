"""What lies on the disks while large tables are made, and after."""

import os
import time

import pytest
from pyspark.sql import functions as F

from likewise import EngineParams, Indicator
from likewise.operators import events as ev
from likewise.operators import model as md
from likewise.operators import similarity as sim
from likewise.operators.querying import complete_queries, item_terms
from likewise.operators.scoring import term_sums
from likewise.plans import recommend as rec
from likewise.plans.train import train
from likewise.sources.staging import run_folder, stage, stage_parts
from shop import BOOKS, EVENTS, NOW, READERS, event_log, usage_rows

PARAMS = EngineParams.of(*EVENTS, num=5)


def tables(spark):
    """Names of the staged tables that are there."""
    folder = run_folder(spark).removeprefix("file:")
    return {x.rsplit("-", 1)[0] + x[-6:] for x in os.listdir(folder)}


def kinds(names):
    return {x[:-6] for x in names}


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def log(spark):
    return stage(event_log(spark), "shop-log")


@pytest.fixture(scope="module")
def model(log):
    return train(log, PARAMS, NOW)


def carts(spark):
    queries = [(f"cart {n} {m}", [a, b]) for n, a in enumerate(BOOKS) for m, b in enumerate(BOOKS) if a < b]
    return spark.createDataFrame([*queries, ("none", None)], "query_id string, item_set array<string>")


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert kept.count() == 7


def test_parts_leave_nothing_but_themselves(spark):
    before = tables(spark)

    def part(n):
        return stage(spark.range(n), "on-the-way").where(F.col("id") > 0)

    whole = stage_parts(spark, [lambda: part(3), lambda: part(5)], "whole")
    assert [r.id for r in whole.orderBy("id").collect()] == [1, 1, 2, 2, 3, 4]
    outer = stage_parts(spark, [lambda: stage_parts(spark, [lambda: part(3)], "inner")], "outer")
    assert outer.count() == 2
    assert sorted(kinds(tables(spark) - before)) == ["outer", "whole"]


def test_a_failed_part_leaves_no_tables_on_the_way(spark):
    before = tables(spark)

    def part():
        stage(spark.range(3), "on-the-way")
        raise ValueError("no")

    with pytest.raises(ValueError):
        stage_parts(spark, [part], "whole")
    stage(spark.range(3), "later")
    assert kinds(tables(spark) - before) == {"later"}


def test_a_model_leaves_no_interactions_or_baskets(spark, log):
    before = tables(spark)
    train(log, PARAMS, NOW)
    left = kinds(tables(spark) - before)
    assert {"correlators", "items", "weights", "postings"} <= left
    assert not left & {"interactions", "users", "baskets", "numbered", "best-pairs"}


def test_correlators_are_the_same_in_slices(spark, monkeypatch):
    usage = spark.createDataFrame([r[:3] for r in usage_rows()], "user string, event string, item string")
    indicators = [Indicator(n) for n in EVENTS]
    want = rows(sim.correlators(usage, indicators))
    cut = ev.prepare(usage, indicators)[0]
    pairs = rows(sim.pair_counts(cut, "buy"))
    most = sum(r[3] for r in pairs) // 2
    slices = sim.pair_slices(cut, "buy", most=most)
    assert 1 < len(slices) < 5
    made = [make() for make in slices]
    assert sorted((r for part in made for r in rows(part)), key=repr) == pairs
    items = [{r[0] for r in rows(part)} for part in made]
    assert sum(map(len, items)) == len(set.union(*items))
    monkeypatch.setattr(sim, "SLICE", most)
    assert rows(sim.correlators(usage, indicators)) == want


def test_postings_are_the_same_in_slices(model, monkeypatch):
    entries = md.index_terms(model.correlators, model.items.select("item", "props"))

    def built():
        found = md.build_postings(entries, model.weights, model.items)
        return rows(found.withColumn("places", F.sort_array("places")))

    want = built()
    monkeypatch.setattr(md, "SLICE", entries.count() // 2)
    assert built() == want


@pytest.mark.parametrize("mode", ["all", "collabFiltering"])
def test_answers_are_the_same_in_waves(spark, log, model, monkeypatch, mode):
    params = EngineParams.of(*EVENTS, num=5, recs_model=mode)
    asked = carts(spark).where("query_id < 'cart 3'").withColumn("user", F.lit(None).cast("string"))
    asked = asked.unionByName(
        spark.createDataFrame([(u, None, u) for u in READERS], "query_id string, item_set array<string>, user string")
    )
    rule = "array<struct<name:string,values:array<string>,bias:double>>"
    novels = F.from_json(F.lit('[{"name":"genre","values":["novel"],"bias":-1}]'), rule)
    asked = asked.withColumn("fields", F.when(F.col("query_id") < "cart 2", novels))
    want = rows(rec.recommend(asked, model, log, params, NOW))
    before = tables(spark)
    monkeypatch.setattr(rec, "FEW", 0)
    monkeypatch.setattr(rec, "WAVE", 2000)
    written = []
    monkeypatch.setattr(rec, "stage_parts", lambda s, parts, name: written.append((name, len(parts))) or stage_parts(s, parts, name))
    got = rec.recommend(asked, model, log, params, NOW)
    assert 1 < dict(written)["answers"] < 6
    assert rows(got) == want and len(want) > 100
    # of what a wave needs on the way nothing is left
    left = kinds(tables(spark) - before)
    assert "answers" in left and not left & {"hits", "terms", "exclusions", "scores", "matched", "short", "names"}


def test_a_query_that_names_no_item_reads_no_correlators(spark, log, model):
    """However many correlators there are: an empty table of queries needs no shuffle of them."""
    asked = carts(spark)
    params = EngineParams.of(*EVENTS)
    full = complete_queries(asked, params, log.schema["entity_id"].dataType, model.items.schema["item"].dataType)
    full = stage(full.withColumn("sig", F.lit(0)), "full")
    text = item_terms(full, model.correlators, params)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "item_set" not in text


def test_only_asked_fields_meet_the_terms(spark, log, model):
    """Postings of event types that no term names are not shuffled."""
    terms = spark.createDataFrame([("q", 0, "buy", BOOKS[0], 1.0, 0)], "query_id string, sig bigint, field string, term string, boost double, bit bigint")
    found = term_sums(terms, model.postings)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "field" in text and "(field" in text and "= buy" in text
    want = model.postings.where((F.col("field") == "buy") & (F.col("term") == BOOKS[0])).select(F.explode("places")).count()
    assert found.count() == want
