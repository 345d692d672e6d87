"""The hook-event streams next to the batch, restarted, with repeats and late events."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.streaming import guard_stream as stream

START = datetime(2024, 5, 1, 12)


def event(n, minutes, command="curl --insecure https://x.example.org"):
    payload = {"hook_event_name": "preToolUse", "tool_name": "bash", "tool_input": {"command": command}}
    return (n, START + timedelta(minutes=minutes), json.dumps(payload))


@pytest.fixture
def folders(tmp_path):
    return {name: f"file://{tmp_path}/{name}" for name in ("events", "risks", "counts", "scan", "count")}


def take(spark, folders, events, files=1):
    stream.land_events(spark.createDataFrame(events, stream.EVENT_SCHEMA), folders["events"], files)
    landed = stream.read_events(spark, folders["events"], files_per_batch=1)
    query = stream.write_risks(stream.guard_risks_once(landed, spark), folders["risks"], folders["scan"], once=True)
    query.awaitTermination()
    return query


def risks(spark, folders):
    return sorted((r.event_id, r.rule_id) for r in spark.read.parquet(folders["risks"]).collect())


def test_micro_batches_restart_repeats_and_late_events(spark, folders):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        first = take(spark, folders, [event(n, n) for n in range(60)], files=3)
        assert len([p for p in first.recentProgress if p.numInputRows]) == 3
        rule = risks(spark, folders)[0][1]
        assert risks(spark, folders) == [(n, rule) for n in range(60)]
        # Nothing new: nothing is done twice.
        take(spark, folders, [event(60, 60)])
        assert risks(spark, folders) == [(n, rule) for n in range(61)]
        # A repeat within the watermark, one event long behind it, a clean one, a new one.
        again = take(spark, folders, [event(58, 58), event(500, -600), event(501, 61, "ls"), event(61, 61)])
        assert risks(spark, folders) == [(n, rule) for n in range(62)]
        assert stream.late_rows(again) == 1

        schema = "event_id bigint, ts timestamp, host string, moment string, action string, rule_id string, quote string, source string"
        for _ in range(2):  # the second run finds nothing new and leaves the counts as they are
            counts = stream.verdict_counts(stream.read_events(spark, folders["risks"], schema=schema))
            stream.write_counts(counts, folders["counts"], folders["count"], once=True).awaitTermination()
            found = {r.window_start: r.n for r in stream.read_counts(spark, folders["counts"]).collect()}
            assert found == {START: 60, START + timedelta(hours=1): 2}
        take(spark, folders, [event(70, 62), event(71, 130)])
        counts = stream.verdict_counts(stream.read_events(spark, folders["risks"], schema=schema))
        stream.write_counts(counts, folders["counts"], folders["count"], once=True).awaitTermination()
        found = {r.window_start: r.n for r in stream.read_counts(spark, folders["counts"]).collect()}
        assert found == {START: 60, START + timedelta(hours=1): 3, START + timedelta(hours=2): 1}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_events_without_an_id_are_kept(spark, folders):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        one, two = event(None, 0), event(None, 1)
        take(spark, folders, [one, one, two, event(3, 1)])
        assert len(risks_of(spark, folders)) == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def risks_of(spark, folders):
    return spark.read.parquet(folders["risks"]).collect()


def test_events_land_in_the_order_of_time(spark, folders):
    """Each file is older than the next in time as in age, whatever the tasks' order, and events without a time stay."""
    events = [event(n, n % 7 * 10 + n) for n in range(90)] + [(200, None, "ls")]
    df = spark.createDataFrame(events, stream.EVENT_SCHEMA).repartition(8)
    stream.land_events(df, folders["events"], 3)
    files = (
        spark.read.parquet(folders["events"]).selectExpr("_metadata.file_modification_time AS age", "ts", "_metadata.file_path AS f")
        .groupBy("f", "age").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).orderBy("age").collect()
    )
    assert len(files) == 3 and len({f.age for f in files}) == 3 and sum(f.n for f in files) == 91
    assert all(x.b < y.a for x, y in zip(files, files[1:]))


def test_a_slice_lands_in_many_files_and_is_one_batch(spark, folders, monkeypatch):
    monkeypatch.setattr(stream, "EVENTS_A_FILE", 10)
    df = spark.createDataFrame([event(n, n) for n in range(45)], stream.EVENT_SCHEMA)
    stream.land_slice(df, folders["events"])
    landed = stream.read_events(spark, folders["events"])
    query = stream.write_risks(stream.guard_risks_once(landed, spark), folders["risks"], folders["scan"], once=True)
    query.awaitTermination()
    assert spark.read.parquet(folders["events"]).selectExpr("_metadata.file_path AS f").distinct().count() == 5
    assert len([p for p in query.recentProgress if p.numInputRows]) == 1
    assert len(risks(spark, folders)) == 45
