"""Inputs that Spark derives from the given tables; every one grows with them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog.functions.vectors import as_double

# One SQL statement per order; the order key picks the shape. The same text
# runs on Spark and on DuckDB.
SHAPES = [
    "concat('SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ', CAST(o_custkey AS STRING))",
    "concat('SELECT c_name FROM customer WHERE c_custkey = ', CAST(o_custkey AS STRING), ' ORDER BY c_name LIMIT 10')",
    "concat('SELECT COUNT(*) FROM orders WHERE o_orderstatus = ''', o_orderstatus, '''')",
    "concat('SELECT c.c_name, SUM(o.o_totalprice) FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"
    " WHERE o.o_orderpriority = ''', o_orderpriority, ''' GROUP BY c.c_name')",
    "concat('SELECT n.n_name, COUNT(DISTINCT c.c_custkey) FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"
    " JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_custkey > ', CAST(o_custkey AS STRING), ' GROUP BY n.n_name')",
    "concat('SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > ',"
    " CAST(o_custkey AS STRING), ')')",
    "concat('WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey)"
    " SELECT c.c_name FROM big JOIN customer c ON big.o_custkey = c.c_custkey WHERE total > ', CAST(o_custkey AS STRING))",
    "concat('SELECT p_name FROM part WHERE p_name LIKE ''%', CAST(o_custkey AS STRING), '%''')",
    "'SELECT s_suppkey FROM supplier UNION SELECT c_custkey FROM customer'",
    "concat('SELECT l_orderkey, RANK() OVER (ORDER BY l_quantity DESC) FROM lineitem WHERE l_orderkey = ',"
    " CAST(o_orderkey AS STRING))",
    "concat('SELECT DISTINCT o.o_orderpriority FROM orders o, customer c WHERE o.o_custkey = c.c_custkey"
    " AND c.c_custkey = ', CAST(o_custkey AS STRING))",
    "'COMMIT'",
]


def _shape(key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(SHAPES[:-1]))
    return f"CASE ({key}) % {len(SHAPES)} {whens} ELSE {SHAPES[-1]} END"


QUERY_LOG_SQL = f"""SELECT o_orderkey AS query_id,
  concat('db', CAST(o_custkey % 5 AS STRING)) AS db_id,
  o_custkey % 20 AS user_id,
  o_orderdate AS ts,
  {_shape('o_orderkey')} AS gold_sql,
  {_shape('o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END')} AS pred_sql
FROM orders"""

# Gold and predicted result rows: the prediction permutes the columns and shifts the rows.
RESULT_ROWS_SQL = """SELECT l_orderkey % 50 AS query_id, 'gold' AS side,
  concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)) AS row_id,
  CAST(l_partkey AS STRING) AS c0, CAST(l_suppkey AS STRING) AS c1, CAST(l_linenumber AS STRING) AS c2
FROM lineitem WHERE l_linenumber <= 4
UNION ALL
SELECT l_orderkey % 50, 'pred',
  concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)),
  CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)
FROM lineitem WHERE l_linenumber >= 2"""

# Results of up to seven rows per order. The prediction loses some lines of returned goods; every other
# query accepts a second gold without any of them; a 17th of the runs fails; some orders have no row on either side.
SMALL_RESULTS_SQL = """SELECT l_orderkey AS query_id, 'gold' AS side, 0 AS gold_no, CAST(l_partkey AS STRING) AS c0, CAST(l_suppkey AS STRING) AS c1
FROM lineitem WHERE l_quantity > 10
UNION ALL SELECT l_orderkey, 'gold', 1, CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)
FROM lineitem WHERE l_quantity > 10 AND l_returnflag <> 'R' AND l_orderkey % 2 = 0
UNION ALL SELECT l_orderkey, 'pred', 0, CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)
FROM lineitem WHERE l_quantity > 10 AND (l_returnflag <> 'R' OR l_linenumber = 1) AND l_orderkey % 17 <> 0"""
SMALL_QUERIES_SQL = "SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_golds, o_orderkey % 17 = 0 AS failed FROM orders"

# Long results per supplier: every third supplier's prediction has one column off by one; half of those accept that as a second gold.
LARGE_RESULTS_SQL = """SELECT l_suppkey AS query_id, 'gold' AS side, 0 AS gold_no, CAST(l_orderkey AS STRING) AS c0, CAST(l_linenumber AS STRING) AS c1
FROM lineitem
UNION ALL SELECT l_suppkey, 'gold', 1, CAST(l_orderkey AS STRING), CAST(l_linenumber + 1 AS STRING)
FROM lineitem WHERE l_suppkey % 6 = 0
UNION ALL SELECT l_suppkey, 'pred', 0, CAST(l_orderkey AS STRING), CAST(l_linenumber + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS STRING)
FROM lineitem"""
LARGE_QUERIES_SQL = "SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 6 = 0 THEN 2 ELSE 1 END AS n_golds, s_suppkey < 0 AS failed FROM supplier"

# One status row per statement of the log: its last shape is no query, and some runs take too long.
RUN_STATUS_SQL = """SELECT o_orderkey AS query_id,
  CASE WHEN o_orderkey % 12 = 11 THEN 'not a query' WHEN o_orderkey % 17 = 0 THEN 'timeout' END AS error
FROM orders"""

# Results kept of earlier runs: some are empty.
CACHED_RESULTS_SQL = """SELECT l_orderkey AS query_id, sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS n_rows
FROM lineitem GROUP BY l_orderkey"""

NL_PAIRS_SQL = """SELECT u.conv_id, u.turn, u.text AS reference, a.text AS generated
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""

# Repeated runs: an event is one run of the question its user stands for.
RUNS_SQL = "SELECT user_id AS question_id, event_id AS run, event_type AS prediction FROM events"

LABEL_PAIRS_SQL = """SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS label,
  CASE WHEN d.n_chars >= 1000 THEN 'good' ELSE 'bad' END AS pred
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

# A catalog that grows with `part`: twelve consecutive parts are the columns of one table.
SCHEMA_COLUMNS_SQL = """SELECT concat('db', CAST(t % 5 AS STRING)) AS db_id,
  concat('T', CAST(t AS STRING)) AS table_name,
  p_partkey % 12 AS ordinal,
  upper(concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey % 12 AS STRING))) AS column_name,
  lower(p_type) AS data_type,
  CASE WHEN p_partkey % 12 = 1 THEN 'PRIMARY KEY' ELSE '' END AS pkey,
  CASE WHEN p_partkey % 12 = 5 AND t >= 5
    THEN concat('FOREIGN KEY T', CAST(t - 5 AS STRING), ' (ID)') ELSE '' END AS fkey
FROM (SELECT *, CAST(floor(p_partkey / 12) AS BIGINT) AS t FROM part) AS numbered"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_ROWS = 100_000  # rows of a task that works on every row's text


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out for per-row text work when the input has too few splits: fewer than cores, or of too many rows.

    Small columns pack millions of rows into a split, so a task's time would grow with the table. The rows of the
    files are known from their footers; a scan that has enough splits is left alone.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def _from_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    # Frames as arguments, not temp views: two callers may use different folders at once.
    frames = {name: table(spark, sf_dir, name) for name in tables}
    for name in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(sql, **frames)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]


def log_of_orders(orders: DataFrame) -> DataFrame:
    """The query log of an orders frame, batch or stream."""
    return orders.select(
        F.col("o_orderkey").alias("query_id"),
        F.concat(F.lit("db"), (F.col("o_custkey") % 5).cast("string")).alias("db_id"),
        (F.col("o_custkey") % 20).alias("user_id"),
        F.col("o_orderdate").alias("ts"),
        F.expr(_shape("o_orderkey")).alias("gold_sql"),
        F.expr(_shape("o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END")).alias("pred_sql"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of_orders(spread(table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, a file or a folder of files, as a file stream."""
    schema = table(spark, sf_dir, name).schema
    # A pattern, since a plain path must be a folder; it matches that one name, whichever of the two it is.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, RESULT_ROWS_SQL, "lineitem")


def small_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Short results, and the queries they belong to."""
    return _from_sql(spark, sf_dir, SMALL_RESULTS_SQL, "lineitem"), _from_sql(spark, sf_dir, SMALL_QUERIES_SQL, "orders")


def large_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Long results, and the queries they belong to."""
    return _from_sql(spark, sf_dir, LARGE_RESULTS_SQL, "lineitem"), _from_sql(spark, sf_dir, LARGE_QUERIES_SQL, "supplier")


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, RUN_STATUS_SQL, "orders")


def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, CACHED_RESULTS_SQL, "lineitem")


def nl_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, NL_PAIRS_SQL, "conversations")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, RUNS_SQL, "events")


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, LABEL_PAIRS_SQL, "labels", "documents")


def schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_sql(spark, sf_dir, SCHEMA_COLUMNS_SQL, "part")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", as_double(F.col("embedding")).alias("embedding")
    )


