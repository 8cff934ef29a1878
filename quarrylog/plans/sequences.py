"""Votes, samples, ordering-dependent rows and log context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.functions import sqltext
from quarrylog.inputs import QUERY_LOG_SQL, RUNS_SQL, query_log, runs, table
from quarrylog.operators import log_context, sampling, sequence, validation, votes
from quarrylog.operators.compute import once
from quarrylog.operators.joins import spread_join
from quarrylog.plans.workload import LEVEL, PARTS, STRUCTURE
from quarrylog.registry import query


def gold() -> Column:
    return F.col("gold_sql")


def used_tables() -> Column:
    return sqltext.table_refs(gold())


REFS = o.with_(query_log=QUERY_LOG_SQL, **o.refs("query_log", "gold_sql"))


@query("a20_majority_vote", o.with_(runs=RUNS_SQL) + """, c AS (SELECT question_id, prediction, count(*) AS votes, min(run) AS first_run FROM runs GROUP BY ALL)
SELECT question_id, prediction FROM c QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, first_run) = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = votes.majority_vote(runs(spark, sf_dir), "question_id", "run", "prediction")
    return best.select("question_id", "prediction")


@query("w1_first_by_count", o.with_(runs=RUNS_SQL) + """, c AS (SELECT question_id, prediction, count(*) AS votes, min(run) AS first_run FROM runs GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, first_run) = 1""")
def first_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.majority_vote(runs(spark, sf_dir), "question_id", "run", "prediction")


@query("a21_three_run_vote", o.QL + f"""SELECT query_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE c END AS vote
  FROM (SELECT query_id, pred_sql AS a, gold_sql AS b, {o.masked('pred_sql')} AS c FROM query_log) AS r""")
def three_run_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = F.col("pred_sql")
    vote = votes.three_run_vote(pred, gold(), sqltext.mask_literals(pred))
    return query_log(spark, sf_dir).select("query_id", vote.alias("vote"))


@query("a22_split_questions", o.with_(runs=RUNS_SQL) + """SELECT question_id, count(DISTINCT prediction) AS n_answers
  FROM runs GROUP BY question_id HAVING count(DISTINCT prediction) = 5""")
def split_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.split_questions(runs(spark, sf_dir), "question_id", "prediction", 5)


@query("a24_progress", o.QL + """SELECT db_id, round_even(count(*) FILTER (gold_sql = pred_sql) * 100.0 / count(*), 2) AS percentage
  FROM query_log GROUP BY db_id""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(gold() == F.col("pred_sql"))
    return query_log(spark, sf_dir).groupBy("db_id").agg(F.bround(done * 100.0 / F.count("*"), 2).alias("percentage"))


@query("a31_score_grid", """WITH log AS (SELECT l_linenumber % 3 * 5 AS k, CASE l_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 5 END AS n, l_discount FROM lineitem)
SELECT k, round(avg(l_discount) FILTER (n = 0), 6) AS n0, round(avg(l_discount) FILTER (n = 1), 6) AS n1,
  round(avg(l_discount) FILTER (n = 5), 6) AS n5 FROM log GROUP BY k""")
def score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for scored runs: tables given (k) by examples given (n)."""
    log = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 3 * 5).alias("k"),
        F.when(F.col("l_orderkey") % 3 == 0, 0).when(F.col("l_orderkey") % 3 == 1, 1).otherwise(5).alias("n"),
        "l_discount",
    )
    grid = log.groupBy("k").pivot("n", [0, 1, 5]).agg(F.avg("l_discount"))
    return grid.select("k", *[F.round(str(n), 6).alias(f"n{n}") for n in (0, 1, 5)])


@query("w2_group_size", "SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS size FROM documents")
def group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    sizes = docs.groupBy("source").agg(F.count("*").alias("size"))
    return spread_join(docs, sizes, ["source"], ["doc_id"], n="size").select("doc_id", "source", "size")


@query("w3_row_ids", "SELECT query_id, row_number() OVER (ORDER BY gold_sql, query_id) AS pos FROM (" + QUERY_LOG_SQL + ") AS q")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir).select("gold_sql", "query_id")
    return sequence.with_position(sequence.ordered(log, ["gold_sql", "query_id"])).select("query_id", "pos")


@query("w4_step_durations", """SELECT user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS seconds FROM events""")
def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_context.step_durations(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("w5_repeat_dedupe", o.QL + """, t AS (SELECT db_id, query_id, upper(gold_sql) AS x, lag(upper(gold_sql)) OVER w AS p FROM query_log
    WINDOW w AS (PARTITION BY db_id ORDER BY query_id)),
 b AS (SELECT db_id, query_id, CASE WHEN p IS NULL OR NOT (contains(x, p) OR contains(p, x)) THEN 1 ELSE 0 END AS s FROM t),
 r AS (SELECT *, sum(s) OVER (PARTITION BY db_id ORDER BY query_id) AS run FROM b),
 n AS (SELECT *, row_number() OVER (PARTITION BY db_id, run ORDER BY query_id) AS k FROM r)
SELECT db_id, query_id FROM n WHERE k % 2 = 1""")
def repeat_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_context.drop_consecutive_repeats(query_log(spark, sf_dir), "query_id", "db_id", "gold_sql")


@query("w6_consecutive_runs", """WITH t AS (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS p FROM events),
 r AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS run FROM t)
SELECT CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY run ORDER BY event_id) - 1 AS "offset", event_id, event_type FROM r""")
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_context.consecutive_runs(table(spark, sf_dir, "events"), "event_id", "event_type")


@query("w7_table_log", REFS + """, u AS (SELECT query_id, db_id, length(gold_sql) AS n, unnest(tabs) AS table_name FROM refs),
 t AS (SELECT db_id, table_name, query_id, CAST(row_number() OVER (PARTITION BY db_id, table_name ORDER BY n, query_id) AS INTEGER) AS rank FROM u),
 k AS (SELECT * FROM t WHERE rank <= 15),
 s AS (SELECT db_id, table_name, count(*) AS n FROM k GROUP BY ALL),
 e AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY db_id ORDER BY table_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM s)
SELECT db_id, table_name, rank, query_id FROM k JOIN (SELECT db_id, table_name FROM e WHERE spent < 50) AS x USING (db_id, table_name)""")
def table_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_context.table_log(query_log(spark, sf_dir), "query_id", "db_id", "gold_sql", used_tables(), cap=15, budget=50)


@query("w7_table_log_once", "WITH RECURSIVE " + REFS.removeprefix("WITH ") + """, u AS (SELECT db_id, gold_sql, unnest(tabs) AS table_name, query_id FROM refs),
 first AS (SELECT db_id, table_name, gold_sql, min(query_id) AS query_id FROM u GROUP BY ALL),
 listed AS MATERIALIZED (SELECT db_id, table_name, row_number() OVER (PARTITION BY db_id ORDER BY table_name) AS place,
   list({'k': query_id, 't': md5(gold_sql)} ORDER BY length(gold_sql), query_id)[1:80] AS texts FROM first GROUP BY db_id, table_name),
 walk AS (SELECT DISTINCT db_id, CAST(0 AS BIGINT) AS place, '' AS table_name, CAST([] AS VARCHAR[]) AS used, 50 AS budget, CAST([] AS STRUCT(k BIGINT, t VARCHAR)[]) AS fresh FROM listed
   UNION ALL SELECT db_id, place, table_name, list_concat(used, list_transform(f, lambda x: x.t)), budget - len(f), f FROM (
     SELECT w.db_id, l.place, l.table_name, w.used, w.budget, list_filter(l.texts, lambda x: NOT list_contains(w.used, x.t))[1:15] AS f
     FROM walk w JOIN listed l ON l.db_id = w.db_id AND l.place = w.place + 1 WHERE w.budget > 0) AS step)
SELECT db_id, table_name, CAST(generate_subscripts(fresh, 1) AS INTEGER) AS rank, unnest(fresh).k AS query_id FROM walk WHERE len(fresh) > 0""")
def table_log_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_context.table_log_once(query_log(spark, sf_dir), "query_id", "db_id", "gold_sql", used_tables(), cap=15, budget=50)


@query("w8_head_and_tail", o.QL + """, h AS (SELECT query_id, gold_sql, 'head' AS part FROM query_log ORDER BY query_id LIMIT 15),
 t AS (SELECT query_id, gold_sql, 'tail' AS part FROM query_log ORDER BY query_id DESC LIMIT 15)
SELECT query_id, gold_sql, min(part) AS part FROM (SELECT * FROM h UNION ALL SELECT * FROM t) AS u GROUP BY ALL""")
def head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head_and_tail(query_log(spark, sf_dir).select("query_id", "gold_sql"), "query_id", 15, 7)


@query("w9_latest_write", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("last")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", "last.*")


@query("t9_shortest_query", REFS + """SELECT table_name, query_id FROM (SELECT query_id, length(gold_sql) AS n, unnest(tabs) AS table_name FROM refs) AS u
  QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY n, query_id) = 1""")
def shortest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_context.shortest_per_table(query_log(spark, sf_dir), "query_id", "gold_sql", used_tables())


def _hash(seed: int) -> str:
    return f"md5(concat('{seed}-', CAST(query_id AS VARCHAR)))"


_BUSY = """(SELECT db_id FROM (SELECT db_id, count(*) AS n FROM query_log GROUP BY db_id) AS c WHERE n > 50
  ORDER BY md5(concat('42-', db_id)), db_id LIMIT 1)"""


@query("t10_seeded_sample", o.QL + f"""SELECT query_id, db_id FROM query_log WHERE db_id = {_BUSY} ORDER BY {_hash(42)}, query_id LIMIT 50""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One database among those with more than 50 queries, then 50 of its queries."""
    log = query_log(spark, sf_dir).select("query_id", "db_id")
    busy = log.groupBy("db_id").agg(F.count("*").alias("n")).where("n > 50").select("db_id")
    return sampling.seeded_sample(log.join(sampling.seeded_sample(busy, "db_id", 1, 42), "db_id"), "query_id", 50, 42).select("query_id", "db_id")


@query("j12_sample_complement", o.QL + f""", s AS (SELECT gold_sql FROM query_log ORDER BY {_hash(42)}, query_id LIMIT 50)
SELECT query_id FROM query_log ANTI JOIN s USING (gold_sql)""")
def sample_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir).select("query_id", "gold_sql")
    chosen = sampling.seeded_sample(log, "query_id", 50, 42).select("gold_sql")
    return log.join(chosen, "gold_sql", "left_anti").select("query_id")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(query_log(spark, sf_dir).select("query_id", "gold_sql"), level=sqltext.difficulty(gold())).drop("gold_sql")


_LEVELS = o.with_(query_log=QUERY_LOG_SQL, parts=f"SELECT *, {STRUCTURE} FROM query_log", levels=f"SELECT query_id, {LEVEL} AS level FROM parts")


@query("t11_difficulty_sample", _LEVELS + f"""SELECT query_id, level FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY {_hash(5)}, query_id) AS k FROM levels) AS r
  WHERE k <= CASE level WHEN 'medium' THEN 11 WHEN 'hard' THEN 3 WHEN 'extra' THEN 1 ELSE 0 END""")
def difficulty_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    quota = {"easy": 0, "medium": 11, "hard": 3, "extra": 1}
    return sampling.quota_sample(_levels(spark, sf_dir), "query_id", "level", quota, 5)


_QUOTA = """, c AS (SELECT level, count(*) AS size FROM levels GROUP BY level),
 q AS (SELECT level, size, greatest(1, CAST(round_even(size * 50 / (SELECT sum(size) FROM c), 0) AS INTEGER)) AS quota FROM c),
 f AS (SELECT level, size, CAST(CASE WHEN level = (SELECT level FROM q ORDER BY size DESC, level DESC LIMIT 1)
   THEN quota + 50 - (SELECT sum(quota) FROM q) ELSE quota END AS INTEGER) AS quota FROM q)"""


@query("t12_proportional_quota", _LEVELS + _QUOTA + "SELECT level, size, quota FROM f")
def proportional_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.proportional_quota(_levels(spark, sf_dir), "level", 50)


@query("t12_proportional_sample", _LEVELS + _QUOTA + f"""SELECT query_id, level FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY {_hash(5)}, query_id) AS k
  FROM levels JOIN f USING (level)) AS r WHERE k <= quota""")
def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.proportional_sample(_levels(spark, sf_dir), "query_id", "level", 50, 5)


@query("p10_skip_list", o.QL + """SELECT query_id, db_id FROM query_log ANTI JOIN
  (SELECT db_id, min(query_id) AS query_id FROM query_log GROUP BY db_id, gold_sql HAVING count(*) > 1) AS s USING (db_id, query_id)""")
def skip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir)
    skipped = log.groupBy("db_id", "gold_sql").agg(F.min("query_id").alias("query_id"), F.count("*").alias("n")).where("n > 1")
    return log.select("query_id", "db_id").join(skipped.select("db_id", "query_id"), ["db_id", "query_id"], "left_anti").select("query_id", "db_id")


@query("p7_annotated", o.QL + "SELECT query_id FROM query_log WHERE gold_sql = pred_sql")
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query counts as annotated once its description is neither null nor empty."""
    question = F.when(gold() == F.col("pred_sql"), gold()).otherwise("")
    return query_log(spark, sf_dir).withColumn("question", question).where("question <> ''").select("query_id")


@query("p16_missing_vectors", "SELECT doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL OR len(embedding) = 0")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    joined = docs.join(vectors, "doc_id", "left")
    return joined.where(F.col("embedding").isNull() | (F.size("embedding") == 0)).select("doc_id")


@query("p17_result_slice", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def result_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").drop("ts", "event_type", "props")


@query("s14_annotation_time", """SELECT o_orderkey, (epoch_us(max(l_shipdate)) - epoch_us(any_value(o_orderdate))) / 1e6 AS seconds
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey""")
def annotation_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploads(spark, sf_dir).accepted.select("o_orderkey", "seconds")


@query("s14_annotation_rejects", """SELECT o_orderkey, 'no downloaded_at' AS errors FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey""")
def annotation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that do not say when their file was handed out."""
    return _uploads(spark, sf_dir).rejected.select("o_orderkey", F.array_join("errors", ", ").alias("errors"))


def _uploads(spark: SparkSession, sf_dir: str) -> validation.Checked:
    """Orders stand for files handed out (none while pending), the last line item for the upload."""
    given = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("downloaded_at"))
    back = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("uploaded_at"))
    elapsed = (F.unix_micros(F.col("uploaded_at").cast("timestamp")) - F.unix_micros(F.col("downloaded_at").cast("timestamp"))) / 1e6
    errors = F.filter(F.array(F.when(F.col("downloaded_at").isNull(), F.lit("no downloaded_at"))), lambda e: e.isNotNull())
    return validation.split_valid(given.join(back, "o_orderkey").select("o_orderkey", "downloaded_at", elapsed.alias("seconds")), errors)
