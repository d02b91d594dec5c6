from pyspark.sql import functions as F

from likewise import EngineParams, Ranking
from likewise.plans.train import refresh_ranks, train
from likewise.sources import store
from likewise.sources.staging import shared_folder, stage
from shop import EVENTS, NOW, event_log

PARAMS = EngineParams.of(*EVENTS)


def test_publish_switch_and_expire(spark, tmp_path):
    path = str(tmp_path / "model")
    assert store.versions(spark, path) == [] and store.load(spark, path) is None
    assert store.load_documents(spark, path).isEmpty()
    model = train(event_log(spark), PARAMS, NOW)
    assert store.publish(model, path) == 1
    first = store.load(spark, path)
    for name, table in model.tables().items():
        assert first.tables()[name].schema.simpleString() == table.schema.simpleString()
        assert first.tables()[name].exceptAll(table).isEmpty() if name in ("correlators", "weights") else True
    assert store.publish(model, path, keep=2, max_write_tasks=1) == 2
    assert store.versions(spark, path) == [1, 2]
    files = list((tmp_path / "model" / "v=2" / "correlators").glob("*.parquet"))
    assert len(files) == 1
    assert store.publish(model, path) == 3
    assert store.versions(spark, path) == [2, 3]  # the one before stays for its readers
    assert not (tmp_path / "model" / "v=1").exists()
    assert store.publish(model, path, keep=1) == 4
    assert store.versions(spark, path) == [4]


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "model")
    model = train(event_log(spark), PARAMS, NOW)
    store.publish(model, path)
    model.items.write.parquet(f"{path}/v=2/items")
    assert store.versions(spark, path) == [1]
    assert store.publish(model, path) == 2


def test_refreshing_ranks_leaves_correlators_and_prefers_new_properties(spark):
    log = event_log(spark)
    model = train(log, PARAMS, NOW)
    newer = log.where("event = '$set'").select(
        *[
            F.create_map(F.lit("genre"), F.array(F.lit("new"))).alias(c) if c == "properties" else F.col(c)
            for c in log.columns
        ]
    )
    params = EngineParams.of(*EVENTS, rankings=(Ranking("popular", event_names=("browse",), duration="5 days"),))
    fresh = refresh_ranks(model, log.where("event <> '$set'").unionByName(newer), params, NOW)
    assert fresh.correlators.exceptAll(model.correlators).isEmpty()
    book = fresh.items.where("item = 'book 00'").first()
    assert book.props["genre"] == ["new"] and book.props["shelf"] == ["0"]
    assert fresh.items.agg(F.sum("popRank")).first()[0] == log.where(
        F.col("event") == "browse"
    ).where(F.col("event_time") >= F.lit("2024-05-27").cast("timestamp")).count()


def test_staged_tables_go_to_the_folder_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    staged = stage(spark.range(3), "numbers")
    assert staged.count() == 3
    run = f"{folder}/likewise/{spark.sparkContext.applicationId}"
    assert staged.inputFiles()[0].startswith(f"file://{run}/numbers-")
