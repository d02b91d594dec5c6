"""Counts kept by changes against counting the whole log."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from likewise import Indicator
from likewise.operators import similarity as sim
from likewise.plans.increments import PairCounts

INDICATORS = [Indicator("buy"), Indicator("look", max_correlators=5)]
SCHEMA = "user string, event string, item string, n long"


def change(rng, n):
    rows = []
    for _ in range(n):
        user = f"u{min(int(rng.expovariate(0.15)), 25)}"
        rows.append((user, rng.choice(["buy", "look", "look", "other"]), f"i{rng.randrange(18)}", rng.choice([1, 1, 2])))
    return rows


@pytest.mark.parametrize("least", [None, 4])
def test_batches_add_up_to_the_whole_log(spark, tmp_path, least):
    rng = random.Random(3)
    store = PairCounts(spark, str(tmp_path / "pairs"), INDICATORS, least)
    log = Counter()
    for batch in range(5):
        rows = change(rng, 150)
        if batch > 1:  # take back some of what there is, so that acts and users vanish
            rows += [(*act, -n) for act, n in rng.sample(sorted(log.items()), 60) if n > 0]
        if batch == 3:
            rows = []
        for user, event, item, n in rows:
            log[user, event, item] += n
        given = spark.createDataFrame(rows, SCHEMA)
        assert store.apply(batch, given) is True
        assert store.apply(batch, given) is False
        raw = [act for act, n in log.items() for _ in range(max(n, 0))]
        whole = sim.correlators(spark.createDataFrame(raw, "user string, event string, item string"), INDICATORS, least)
        assert {tuple(r) for r in store.correlators().collect()} == {tuple(r) for r in whole.collect()}
    assert store.committed() == [0, 1, 2, 3, 4]


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    store = PairCounts(spark, str(tmp_path / "pairs"), INDICATORS)
    rows = [("a", "buy", "x", 1), ("a", "look", "y", 1), ("b", "buy", "x", 1), ("c", "buy", "z", 1)]
    assert store.apply(0, spark.createDataFrame(rows, SCHEMA))
    before = {tuple(r) for r in store.counts().collect()}
    spark.createDataFrame([("x", "look", "y", 99)], "item string, event string, correlator string, n long").write.parquet(
        f"{store.folder}/pairs/batch=1"
    )
    assert store.committed() == [0] and {tuple(r) for r in store.counts().collect()} == before
    assert store.apply(1, spark.createDataFrame(rows[:1], SCHEMA))
    assert {tuple(r) for r in store.counts().collect()} == before
    with pytest.raises(ValueError):
        PairCounts(spark, "x", [Indicator("buy", max_items_per_user=3)])


def test_kept_acts_never_meet(spark, tmp_path):
    """A user with many acts and one more: pairs made are those of the one."""
    store = PairCounts(spark, str(tmp_path / "pairs"), INDICATORS)
    many = spark.range(400).select(
        F.lit("hot").alias("user"), F.lit("buy").alias("event"), F.col("id").cast("string").alias("item"), F.lit(1).cast("long").alias("n")
    )
    store.apply(0, many)
    store.apply(1, spark.createDataFrame([("hot", "look", "new", 1), ("cold", "buy", "1", 1)], SCHEMA))
    assert store._read("pairs", [1]).count() == 400
    assert store._read("pairs", [0]).count() == 400 * 399
