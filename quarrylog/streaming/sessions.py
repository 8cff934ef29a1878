"""Sessions closed by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarrylog.session import new_shared_path, state_session

OPEN = "first_us long, last_us long, n_events long"


def merged_sessions(sessions: list[tuple[int, int, int]], gap_us: int) -> list[tuple[int, int, int]]:
    """Sessions ``(first, last, events)`` in order, joined where less than the gap lies between two."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(sessions):
        if out and first - out[-1][1] < gap_us:
            out[-1] = out[-1][0], max(last, out[-1][1]), out[-1][2] + n
        else:
            out.append((first, last, n))
    return out


class SessionTimers(StatefulProcessor):
    """Keeps a user's open sessions and one timer, for the session that ends first.

    An event opens a session, prolongs one or joins two. When the watermark has
    passed a session's end (its last event and the gap) no event can reach it any
    more: it is handed on once and its state is freed.
    """

    def __init__(self, user: str, gap_us: int):
        self.user, self.gap_us = user, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = [(us, us, 1) for frame in rows for us in frame["us"].tolist()]
        self._keep(merged_sessions([tuple(s) for s in self.open.get()] + seen, self.gap_us))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        sessions = [tuple(s) for s in self.open.get()]
        closed = [s for s in sessions if s[1] + self.gap_us <= passed]
        self._keep([s for s in sessions if s[1] + self.gap_us > passed])
        if closed:
            first, last, n = zip(*closed, strict=True)
            yield pd.DataFrame({self.user: [key[0]] * len(closed), "first_us": first, "last_us": last, "n_events": n})

    def _keep(self, sessions: list[tuple[int, int, int]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer(-(-(min(s[1] for s in sessions) + self.gap_us) // 1000))
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, user: str, ts: str, gap_us: int, delay: str) -> DataFrame:
    """``user, first_us, last_us, n_events`` of each session once it is closed; rows older than the watermark are dropped."""
    timed = events.select(user, F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    kind = dict(events.dtypes)[user]
    schema = f"{user} {kind}, first_us long, last_us long, n_events long"
    return timed.groupBy(user).transformWithStateInPandas(SessionTimers(user, gap_us), schema, "Append", "EventTime")


def session_durations(spark: SparkSession, read, user: str, ts: str, gap_minutes: int = 30, delay: str = "1 hour", progress: list | None = None) -> DataFrame:
    """Every session of a stream that is run to the end of its input: length, and whether it was ``closed``.

    ``read(session)`` gives the stream in the session that keeps the state. Closed
    sessions come from the sink, where each was written once; sessions still open
    when the input ends are flushed from the state. ``progress`` receives the
    progress of each batch.
    """
    owner = state_session(spark)
    out, state = new_shared_path(spark, "sessions"), new_shared_path(spark, "session-state")
    closed = closed_sessions(read(owner), user, ts, gap_minutes * 60_000_000, delay)
    query = closed.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    done = spark.read.schema(closed.schema).parquet(out).withColumn("closed", F.lit(True))
    if any(p.stateOperators for p in query.recentProgress):  # else no batch ran and there is no state
        held = owner.read.format("statestore").option("stateVarName", "open").option("flattenCollectionTypes", "true").load(state)
        still = held.select(F.col(f"key.{user}").alias(user), "list_element.*", F.lit(False).alias("closed"))
        done = done.unionByName(still.select(done.columns))
    return done.select(user, "n_events", "first_us", ((F.col("last_us") - F.col("first_us")) / 1e6).alias("seconds"), "closed")
