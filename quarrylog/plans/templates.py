"""Templates, literal masking and duplicates of a query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.functions import sqltext
from quarrylog.inputs import QUERY_LOG_SQL, query_log
from quarrylog.operators import templates as ops
from quarrylog.registry import query

_MASKED = o.QL + f"SELECT query_id, {o.masked('gold_sql')} AS template FROM query_log"


@query("a10_template_top10", o.QL + f"""SELECT {o.masked('gold_sql')} AS template, count(*) AS n_queries,
  min(query_id) AS first_query_id FROM query_log GROUP BY 1 ORDER BY n_queries DESC, template LIMIT 10""")
def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ops.template_groups(query_log(spark, sf_dir), "gold_sql", "query_id")
    return groups.orderBy(F.desc("n_queries"), "template").limit(10)


@query("f1_masked_literals", _MASKED)
def masked_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select("query_id", sqltext.mask_literals(F.col("gold_sql")).alias("template"))


@query("a10_template_members", o.QL + f"""SELECT sha256({o.masked('gold_sql')}) AS template_id, query_id FROM query_log""")
def template_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.template_members(query_log(spark, sf_dir), "gold_sql", "query_id")


@query("a10_unique_template_count", o.QL + f"""SELECT count(DISTINCT {o.masked('gold_sql')}) AS unique_patterns,
  count(*) AS n_queries FROM query_log""")
def unique_template_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ops.template_groups(query_log(spark, sf_dir), "gold_sql", "query_id")
    return groups.agg(F.count("*").alias("unique_patterns"), F.sum("n_queries").alias("n_queries"))


@query("u3_distinct_sql", o.QL + "SELECT DISTINCT gold_sql FROM query_log")
def distinct_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select("gold_sql").dropDuplicates()


@query("f28_sql_key", o.QL + "SELECT query_id, sha256(gold_sql) AS sql_key FROM query_log")
def sql_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select("query_id", sqltext.sql_key(F.col("gold_sql")).alias("sql_key"))


@query("t8_preview_rows", o.QL + "SELECT query_id, gold_sql FROM query_log ORDER BY query_id LIMIT 10")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select("query_id", "gold_sql").orderBy("query_id").limit(10)


_VALUE_WORDS = o.replaced(
    o.replaced("gold_sql", o.LITERAL, "string_value"), r"\b[0-9]+(?:\.[0-9]+)?\b", "number_value"
)


@query("f2_generalised", o.with_(query_log=QUERY_LOG_SQL, **o.refs("query_log", "gold_sql")) + f"""
SELECT query_id, array_to_string(list_transform({o.found(_VALUE_WORDS, r"[0-9A-Za-z_]+|[ ]+|[^0-9A-Za-z_ ]")},
  lambda w: CASE WHEN list_contains(tabs, upper(w)) THEN concat('table_', list_position(tabs, upper(w)))
    WHEN list_contains(cols, upper(w)) THEN concat('column_', list_position(cols, upper(w))) ELSE w END), '')
  AS query_generalized FROM refs""")
def generalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select("query_id", sqltext.generalise(F.col("gold_sql")).alias("query_generalized"))
