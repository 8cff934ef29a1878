"""Streams over several micro-batches: sessions with timers, first-seen texts, late rows."""

import pytest
from pyspark.sql import functions as F

from quarrylog.session import state_session
from quarrylog.streaming import logs, sessions

EVENTS = "user_id long, ts timestamp"


def minutes(*at):
    """Timestamps on one day, from minutes."""
    return [f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00" if m < 1440 else f"2024-01-{1 + m // 1440:02d} {m % 1440 // 60:02d}:{m % 60:02d}:00" for m in at]


def batches(spark, folder, schema, *rows):
    """One file per micro-batch, in order; returns how to read them as a stream, one file a batch."""
    names = schema.replace(" timestamp", " string")
    for k, part in enumerate(rows):
        frame = spark.createDataFrame(part, names)
        frame = frame.select(*[F.col(c).cast("timestamp").alias(c) if f"{c} timestamp" in schema else F.col(c) for c in frame.columns])
        frame.coalesce(1).write.parquet(f"{folder}/part={k}")
    return lambda session: session.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(*[f"{folder}/part=*"])


def test_sessions_are_closed_once_and_freed(spark, tmp_path):
    rows = [
        [(1, t) for t in minutes(0, 10, 45)] + [(2, t) for t in minutes(5)],
        [(1, t) for t in minutes(300)] + [(2, t) for t in minutes(305, 330)],
        [(2, t) for t in minutes(331)],  # a batch drops what lies behind the watermark that the one before it began with
        [(1, t) for t in minutes(20, 310)] + [(3, t) for t in minutes(600)],  # 20 lies behind 270 and is dropped
        [(3, t) for t in minutes(2000)],
    ]
    progress = []
    read = batches(spark, str(tmp_path / "in"), EVENTS, *rows)
    found = sessions.session_durations(spark, read, "user_id", "ts", progress=progress)
    start = spark.sql("SELECT unix_micros(timestamp'2024-01-01 00:00:00')").first()[0]
    got = sorted((r.user_id, (r.first_us - start) // 60_000_000, r.n_events, r.seconds, r.closed) for r in found.collect())
    assert got == [
        (1, 0, 2, 600.0, True), (1, 45, 1, 0.0, True), (1, 300, 2, 600.0, True), (2, 5, 1, 0.0, True), (2, 305, 3, 1560.0, True),
        (3, 600, 1, 0.0, True), (3, 2000, 1, 0.0, False),
    ]
    held = [p.stateOperators[0].numRowsTotal for p in progress]
    assert max(held) > held[-1]  # state falls once sessions are closed
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) == 1


def test_out_of_order_events_join_sessions(spark, tmp_path):
    rows = [[(1, t) for t in minutes(100, 150)], [(1, t) for t in minutes(125, 90)], [(1, t) for t in minutes(179)]]
    found = sessions.session_durations(spark, batches(spark, str(tmp_path / "in"), EVENTS, *rows), "user_id", "ts")
    assert [(r.n_events, r.seconds, r.closed) for r in found.collect()] == [(5, 89 * 60.0, False)]


def test_one_batch_and_many_agree(spark, sf, tmp_path):
    import __spark_entry__

    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    events.repartitionByRange(5, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "events.parquet"))
    expected = sorted(map(tuple, __spark_entry__.queries()["r3_stream_sessions"](spark, sf).collect()))
    read = lambda s: s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet"))
    got = sessions.session_durations(spark, read, "user_id", "ts", delay="3650 days").drop("closed")
    assert sorted(map(tuple, got.collect())) == expected


def test_sessions_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    read = lambda s: s.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    assert sessions.session_durations(spark, read, "user_id", "ts").collect() == []


def test_merged_sessions():
    assert sessions.merged_sessions([(5, 9, 2), (0, 1, 1), (3, 3, 1)], 4) == [(0, 9, 4)]
    assert sessions.merged_sessions([(0, 0, 1), (4, 4, 1)], 4) == [(0, 0, 1), (4, 4, 1)]
    assert sessions.merged_sessions([], 4) == []


TEXTS = "ts timestamp, sql string"


def test_first_seen_over_days(spark, tmp_path):
    """A text that comes back after two days in another batch was seen."""
    rows = [[(t, "A")] for t in minutes(0, 2880, 5760, 8640)] + [[(minutes(8641)[0], "B"), (minutes(8642)[0], "B")]]
    read = batches(spark, str(tmp_path / "in"), TEXTS, *rows)
    whole = logs.run_available(spark, logs.first_seen(read(state_session(spark)), "ts", "sql"), "append")
    assert sorted(r.sql for r in whole.collect()) == ["A", "B"]
    bounded = logs.run_available(spark, logs.first_seen(read(spark), "ts", "sql", "1 hour"), "append")
    assert sorted(r.sql for r in bounded.collect()) == ["A", "A", "B"]  # forgotten once, after the watermark had passed


@pytest.mark.parametrize("slide,expected", [(None, {("2024-01-01", 2), ("2024-01-04", 2)}), ("12 hours", {("2023-12-31", 2), ("2024-01-01", 2), ("2024-01-03", 2), ("2024-01-04", 2)})])
def test_late_rows_reach_open_windows_only(spark, tmp_path, slide, expected):
    """The second batch's late row is within the watermark, the last batch's is not."""
    rows = [[(minutes(60)[0], "SELECT 1")], [(minutes(30)[0], "SELECT 2")], [(minutes(4330)[0], "SELECT 3")], [(minutes(4331)[0], "SELECT 5")], [(minutes(90)[0], "SELECT 4")]]
    read = batches(spark, str(tmp_path / "in"), TEXTS, *rows)
    counted = logs.templates_per_window(read(spark), "ts", "sql", "1 day", slide)
    found = logs.run_available(spark, counted, "update", ["window_start", "template"])
    assert {(str(r.window_start)[:10], r.n) for r in found.collect()} == expected
