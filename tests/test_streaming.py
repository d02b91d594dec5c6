from datetime import datetime, timedelta

from likewise.streaming.log import (
    read_event_stream,
    run_to_latest,
    run_to_table,
    stream_dedup_events,
    stream_popularity,
)
from shop import SCHEMA

T = datetime(2024, 1, 1)


def arrive(spark, folder, *rows):
    """(event, user, item, hour)"""
    spark.createDataFrame(
        [(e, "user", u, "item", i, None, T + timedelta(hours=h), n) for n, (e, u, i, h) in enumerate(rows)], SCHEMA
    ).coalesce(1).write.mode("append").parquet(folder)


def test_popularity_is_final_behind_the_watermark(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    stream = lambda: stream_popularity(read_event_stream(spark, inbox, SCHEMA), ["a"], "1 day", "6 hours")
    arrive(spark, inbox, ("a", "u", "x", 1), ("a", "v", "x", 2), ("b", "u", "x", 3), ("a", "u", "y", 23))
    assert run_to_table(stream(), out, mark).count() == 0
    # late but inside the allowance, then far enough ahead to close the day
    arrive(spark, inbox, ("a", "u", "x", 20), ("a", "u", "x", 26))
    assert run_to_table(stream(), out, mark).count() == 0
    arrive(spark, inbox, ("a", "u", "z", 60))
    got = {(r.start.day, r["item"], r["rank"]) for r in run_to_table(stream(), out, mark).collect()}
    assert got == {(1, "x", 3.0), (1, "y", 1.0), (2, "x", 1.0)}


def test_open_windows_are_shown_as_they_stand(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def counted():
        stream = stream_popularity(read_event_stream(spark, inbox, SCHEMA), ["a"], "1 day", "6 hours")
        rows = run_to_latest(stream, ["start", "item"], out, mark).collect()
        return {(r.start.day, r["item"], r["rank"]) for r in rows}

    arrive(spark, inbox, ("a", "u", "x", 1), ("a", "v", "x", 2), ("b", "u", "x", 3), ("a", "u", "y", 23))
    assert counted() == {(1, "x", 2.0), (1, "y", 1.0)}
    arrive(spark, inbox, ("a", "u", "x", 20), ("a", "u", "x", 26))
    assert counted() == {(1, "x", 3.0), (1, "y", 1.0), (2, "x", 1.0)}


def test_late_repeats_are_new_once_the_memory_has_passed(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    stream = lambda: stream_dedup_events(read_event_stream(spark, inbox, SCHEMA), "2 hours")
    arrive(spark, inbox, ("a", "u", "x", 1))
    assert run_to_table(stream(), out, mark).count() == 1
    arrive(spark, inbox, ("a", "u", "y", 30))
    arrive(spark, inbox, ("a", "u", "z", 31))
    run_to_table(stream(), out, mark)
    arrive(spark, inbox, ("a", "u", "x", 40), ("a", "u", "x", 2))
    seen = run_to_table(stream(), out, mark)
    assert seen.where("target_entity_id = 'x'").count() == 2


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    stream = lambda: stream_dedup_events(read_event_stream(spark, inbox, SCHEMA), "2 days")
    arrive(spark, inbox, ("a", "u", "x", 1), ("a", "u", "x", 2), ("a", "u", "y", 2))
    assert run_to_table(stream(), out, mark).count() == 2
    arrive(spark, inbox, ("a", "u", "x", 5), ("a", "v", "x", 5))
    assert run_to_table(stream(), out, mark).count() == 3
