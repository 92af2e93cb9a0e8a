"""Streams against their batch form: sessions with merges and late rows, ordered events with a state and timers."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidelake.plans import streams
from tidelake.streaming import ordering, sessions

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime.datetime(2024, 1, 1)


def event(i, hours, user=1, kind="view", value=1.0):
    return (i, START + datetime.timedelta(hours=hours), user, kind, value)


def write(spark, path, *steps):
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{path}/{k}")
    return f"{path}/*"


def test_sessions_merge_and_late_rows_are_counted(spark, tmp_path):
    first = [event(1, 0), event(2, 10, kind="click"), event(3, 0, user=2)]
    bridge = [event(4, 5), event(5, 60)]  # joins the first user's two sessions, in time; moves the watermark to 36 h
    ahead, late = [event(7, 100)], [event(6, 20), event(8, 101)]  # the twentieth hour is past, and no session holds it
    source = write(spark, tmp_path / "in", first, bridge, ahead, late)
    dropped = sessions.run(spark, source, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.user_id, r.started.hour, r.n): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert dropped == 1 and set(got) == {(1, 0, 3), (2, 0, 1), (1, 12, 1)}
    assert got[1, 0, 3].kinds == ["click", "view"] and got[1, 0, 3].ended == START + datetime.timedelta(hours=10)
    table = spark.createDataFrame(first + bridge + [(8, None, 1, "view", 1.0), (9, START, None, "view", 1.0)], EVENTS)
    batch = {(r.user_id, r.started, r.n) for r in sessions.sessions(table).collect()}
    assert {(k[0], r.started, r.n) for k, r in got.items() if r.started < START + datetime.timedelta(hours=24)} <= batch and len(batch) == 3


def told(rows):
    return sorted((r.stream, r.sequence, r.kind, r.stage, r.outcome, r.occurred_at) for r in rows)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_each_fault_of_a_stream_is_mended(rocks, tmp_path):
    def analysis(stream, *events):
        return [(stream, place, START + datetime.timedelta(minutes=m), kind, stage) for place, (m, kind, stage) in enumerate(events)]

    rows = [
        *analysis("good", (0, "stage_start", "plan"), (1, "stage_end", "plan"), (2, "completion", None)),
        *analysis("twice", (0, "completion", None), (1, "completion", None), (2, "finding", None)),
        *analysis("back", (10, "stage_start", "plan"), (5, "stage_end", "plan"), (20, "completion", None)),
        *analysis("open", (0, "stage_start", "plan"), (1, "finding", None)),
        *analysis("failed", (0, "stage_start", "plan"), (1, "stage_end", "plan"), (2, "error", None)),
        *analysis("silent", (0, "stage_start", "plan"), (800, "completion", None)),
    ]
    schema = "stream string, place long, at timestamp, kind string, stage string"
    table = rocks.createDataFrame(rows, schema)
    want = told(ordering.complete(table).collect())
    by = {}
    for stream, k, kind, stage, outcome, at in want:
        by.setdefault(stream, []).append((kind, stage, outcome, (at - START).total_seconds() / 60))
        assert k == len(by[stream]) - 1
    assert by["good"][-1][0] == "completion" and by["twice"] == [("completion", None, None, 0)]
    assert [x[3] for x in by["back"]] == [10, 10, 20]
    assert by["open"] == [("stage_start", "plan", None, 0), ("finding", None, None, 1), ("error", None, None, 721), ("stage_end", "plan", "failed", 721), ("completion", None, "failed", 721)]
    assert by["failed"][-2:] == [("error", None, None, 2), ("completion", None, "failed", 722)]
    assert by["silent"] == [("stage_start", "plan", None, 0), ("error", None, None, 720), ("stage_end", "plan", "failed", 720), ("completion", None, "failed", 720)]
    # the same by state and timers: rows come in three steps, and a last stream moves the watermark past all timers
    for k, part in enumerate((table.where("place = 0"), table.where("place > 0 AND at < '2024-01-01 06:00:00'"), table.where("at > '2024-01-01 06:00:00'"), *(rocks.createDataFrame([("clock", d, START + datetime.timedelta(days=d), "completion", None)], schema) for d in (3, 4, 5)))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = ordering.follow(source, late="0 seconds").writeStream.outputMode("append").format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert told(rocks.table("ordered").where("stream <> 'clock'").collect()) == want


def test_every_stream_of_the_events_ends_once(spark):
    out = streams.stream_ordered(spark, "/root/testdata/sf0.001")
    n = out.groupBy("stream").agg(F.count_if(F.col("kind") == "completion").alias("ends"), F.max("sequence").alias("last"), F.max_by("kind", "sequence").alias("kind"), F.count("*").alias("n"))
    assert n.where("ends <> 1 OR kind <> 'completion' OR last <> n - 1").count() == 0 and n.count() > 10
