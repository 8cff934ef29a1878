"""Streams over the given files, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.inputs import log_of_orders, query_log, stream
from quarrylog.plans.workload import STATEMENT
from quarrylog.registry import query
from quarrylog.session import new_shared_path, state_session
from quarrylog.streaming import logs, sessions


@query("r1_stream_ingest", o.QL + f"SELECT query_id, gold_sql AS sql FROM query_log WHERE {STATEMENT}")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "log-lines")
    query_log(spark, sf_dir).select(F.concat_ws("\t", "query_id", "gold_sql").alias("value")).write.text(path)
    return logs.run_available(spark, logs.ingest_statements(spark.readStream.text(path)), "append")


@query("r2_stream_templates", o.QL + f"""SELECT CAST(epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start_us,
  {o.masked('gold_sql')} AS template, count(*) AS n FROM query_log GROUP BY ALL""")
def stream_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of_orders(stream(spark, sf_dir, "orders"))
    counted = logs.templates_per_window(log, "ts", "gold_sql", "1 day")
    found = logs.run_available(spark, counted, "update", ["window_start", "template"])
    return found.select(F.unix_micros("window_start").alias("start_us"), "template", "n")


@query("r2_stream_sliding", o.QL + f"""SELECT CAST((epoch_us(ts) // 21600000000 - j) * 21600000000 AS BIGINT) AS start_us, {o.masked('gold_sql')} AS template, count(*) AS n
  FROM query_log JOIN (VALUES (0), (1), (2), (3)) AS t(j) ON true GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of_orders(stream(spark, sf_dir, "orders"))
    counted = logs.templates_per_window(log, "ts", "gold_sql", "1 day", "6 hours")
    found = logs.run_available(spark, counted, "update", ["window_start", "template"])
    return found.select(F.unix_micros("window_start").alias("start_us"), "template", "n")


@query("r3_stream_sessions", """WITH t AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
 s AS (SELECT user_id, us, sum(CASE WHEN p IS NULL OR us - p >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS k FROM t),
 x AS (SELECT user_id, count(*) AS n_events, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY user_id, k)
SELECT user_id, n_events, first_us, (last_us - first_us) / 1e6 AS seconds FROM x""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions: closed ones by their timers, those still open at the end of the input from the state."""
    return sessions.session_durations(spark, lambda s: stream(s, sf_dir, "events"), "user_id", "ts").drop("closed")


@query("r4_stream_first_seen", o.QL + "SELECT DISTINCT gold_sql FROM query_log")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of_orders(stream(state_session(spark), sf_dir, "orders"))
    return logs.run_available(spark, logs.first_seen(log, "ts", "gold_sql"), "append")
