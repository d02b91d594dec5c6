import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from likewise.operators.groups import number_rows, top_per_group


@pytest.mark.parametrize("shards", [1, 3, 64, None])
def test_top_per_group_is_exact_with_a_hot_group(spark, shards):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(40)}", rng.randrange(900), n) for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    got = defaultdict(list)
    for r in top_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 25, shards=shards).collect():
        got[r.g].append((r.rnk, r.v, r.id))
    groups = defaultdict(list)
    for g, v, i in rows:
        groups[g].append((v, i))
    for g, members in groups.items():
        best = sorted(members, key=lambda m: (-m[0], m[1]))[:25]
        assert sorted(got[g]) == [(n + 1, v, i) for n, (v, i) in enumerate(best)]


def test_sharded_selection_shuffles_even_after_a_join_on_part_of_the_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(1000).select((F.col("id") % 10).alias("u"), (F.col("id") % 3).alias("e"), "id")
        joined = left.join(spark.range(10).select(F.col("id").alias("u")), "u", "left_semi")
        plan = top_per_group(joined, ["u", "e"], [F.col("id")], 5)
        flat = plan._jdf.queryExecution().executedPlan().toString()
        sharded = top_per_group(joined, ["u", "e"], [F.col("id")], 5, shards=8)
        deep = sharded._jdf.queryExecution().executedPlan().toString()
        assert deep.count("Exchange hashpartitioning") == flat.count("Exchange hashpartitioning") + 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_number_rows_counts_in_order(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 100003).alias("v"), F.lit("x").alias("same"))
    got = number_rows(df.repartition(9), [F.col("v").desc()]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, n + 1))
    assert [r.v for r in got] == sorted((r.v for r in got), reverse=True)


def test_number_rows_with_one_value_holding_most_rows(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(2).alias("v"), "id")
    got = number_rows(df, [F.col("v"), F.col("id")]).collect()
    assert sorted((r.v, r.id) for r in got) == [(r.v, r.id) for r in sorted(got, key=lambda r: r.pos)]
