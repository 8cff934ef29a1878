"""Table, column and label scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.functions import sqltext
from quarrylog.functions.scores import set_counts
from quarrylog.functions.text import significant
from quarrylog.inputs import LABEL_PAIRS_SQL, QUERY_LOG_SQL, label_pairs, query_log
from quarrylog.operators import scoring as ops
from quarrylog.operators.compute import once
from quarrylog.registry import query


def gold_tables() -> Column:
    return sqltext.table_refs(F.col("gold_sql"))


def pred_tables() -> Column:
    return sqltext.table_refs(F.col("pred_sql"))


SETS = dict(
    query_log=QUERY_LOG_SQL,
    **o.refs("query_log", "gold_sql"),
    **o.refs("refs", "pred_sql", "p_"),
    counts=f"SELECT *, {o.score_columns('tabs', 'p_tabs')} FROM p_refs",
    ratio=f"SELECT *, {o.RATIOS} FROM counts",
    scores="SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM ratio",
)
SCORES = o.with_(**SETS)


def table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.set_scores(query_log(spark, sf_dir), ["query_id"], gold_tables(), pred_tables())


@query("e1_set_scores", SCORES + """SELECT query_id, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall,
  round(f, 6) AS f1, acc AS accuracy FROM scores""")
def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return table_scores(spark, sf_dir).select("query_id", "tp", "fp", "fn", *ratios, "accuracy")


@query("e2_set_scores_null_rule", o.with_(**{**SETS, "ruled": """SELECT query_id,
    CASE WHEN gold_sql = 'COMMIT' OR pred_sql = 'COMMIT' THEN 0.0 WHEN len(tabs) = 0 AND len(p_tabs) = 0 THEN 1.0 ELSE p END AS precision,
    CASE WHEN gold_sql = 'COMMIT' OR pred_sql = 'COMMIT' THEN 0.0 WHEN len(tabs) = 0 AND len(p_tabs) = 0 THEN 1.0 ELSE r END AS recall,
    CASE WHEN gold_sql = 'COMMIT' OR pred_sql = 'COMMIT' THEN 0.0 WHEN len(tabs) = 0 AND len(p_tabs) = 0 THEN 1.0 ELSE f END AS f1 FROM scores"""})
    + "SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ruled")
def set_scores_null_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(sqltext.select_count(F.col("gold_sql")) > 0, gold_tables())
    pred = F.when(sqltext.select_count(F.col("pred_sql")) > 0, pred_tables())
    scores = ops.set_scores_null_rule(query_log(spark, sf_dir), ["query_id"], gold, pred)
    return scores.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("e3_table_retrieval", SCORES + """SELECT round(avg(CAST(acc AS INTEGER)), 6) AS accuracy, round(avg(r), 6) AS recall,
  round(avg(p), 6) AS precision, round(avg(f), 6) AS f1 FROM scores""")
def table_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 summed up by A17."""
    summary = ops.macro_summary(table_scores(spark, sf_dir))
    return summary.select(*[F.round(c, 6).alias(c) for c in summary.columns])


@query("a18_micro_summary", SCORES + """, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(CAST(acc AS INTEGER)) AS acc FROM counts JOIN (SELECT query_id AS q, acc FROM ratio) ON q = query_id)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round(acc, 6) AS accuracy FROM s""")
def micro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ops.micro_summary(table_scores(spark, sf_dir))
    return summary.select(*[F.round(c, 6).alias(c) for c in summary.columns])


@query("e4_table_recall", SCORES + """SELECT query_id, CASE WHEN len(tabs) > 0 AND len(p_tabs) > 0
  THEN round(tp / len(tabs), 6) END AS recall FROM scores""")
def table_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query_log(spark, sf_dir).select("query_id", gold_tables().alias("g"), pred_tables().alias("p"))
    shared = F.size(F.array_intersect("g", "p")) / F.size("g")
    return rows.select(
        "query_id", F.when((F.size("g") > 0) & (F.size("p") > 0), F.round(shared, 6)).alias("recall")
    )


@query("e5_column_accuracy", SCORES + """SELECT round(sum(CASE WHEN len(cols) > 0
  THEN len(list_intersect(cols, p_cols)) * 100.0 / len(cols) ELSE 0 END) / count(*), 6) AS column_accuracy FROM scores""")
def column_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query_log(spark, sf_dir).select(sqltext.column_refs(F.col("gold_sql")).alias("g"), sqltext.column_refs(F.col("pred_sql")).alias("p"))
    share = F.when(F.size("g") > 0, F.size(F.array_intersect("g", "p")) * 100.0 / F.size("g")).otherwise(0.0)
    return rows.agg(F.round(F.avg(share), 6).alias("column_accuracy"))


@query("a19_bucket_scores", SCORES + """, b AS (SELECT CASE WHEN len(tabs) >= 3 THEN '3+' ELSE CAST(len(tabs) AS VARCHAR) END AS n_tables,
  avg(f) * 100 AS m FROM scores WHERE len(tabs) >= 1 GROUP BY 1)
SELECT n_tables, CAST(printf('%.2e', m) AS DOUBLE) AS f1 FROM b""")
def bucket_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir).select("query_id", "gold_sql", "pred_sql")
    rows = once(log, g=gold_tables(), p=pred_tables()).where("size(g) > 0")
    bucket = F.when(F.size("g") >= 3, "3+").otherwise(F.size("g").cast("string"))
    scores = ops.set_scores(rows.withColumn("n_tables", bucket), ["n_tables"], F.col("g"), F.col("p"))
    return scores.groupBy("n_tables").agg(significant(F.avg("f1") * 100).alias("f1"))


@query("p13_prefix_gate", SCORES + """SELECT query_id, CASE WHEN len(list_filter(tabs, lambda t: contains(t, 'REG'))) = 0
  THEN round(f, 6) END AS f1 FROM scores""")
def prefix_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query_log(spark, sf_dir).select("query_id", gold_tables().alias("g"), pred_tables().alias("p"))
    gated = F.exists("g", lambda t: t.contains("REG"))
    scores = ops.set_scores(rows.withColumn("gated", gated), ["query_id", "gated"], F.col("g"), F.col("p"))
    return scores.select("query_id", F.when(~F.col("gated"), F.round("f1", 6)).alias("f1"))


@query("u1_set_counts", SCORES + "SELECT query_id, tp, fp, fn FROM scores")
def set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query_log(spark, sf_dir).select("query_id", gold_tables().alias("g"), pred_tables().alias("p"))
    return rows.select("query_id", *[c.alias(n) for n, c in set_counts(F.col("g"), F.col("p")).items()])


@query("u2_set_equality", SCORES + "SELECT query_id, acc AS same_tables FROM scores")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_scores(spark, sf_dir).select("query_id", F.col("accuracy").alias("same_tables"))


@query("j1_gold_pred_join", o.QL + """SELECT g.query_id, g.gold_sql = p.pred_sql AS exact FROM query_log g JOIN query_log p USING (query_id)""")
def gold_pred_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir)
    joined = log.select("query_id", "gold_sql").join(log.select("query_id", "pred_sql"), "query_id")
    return joined.select("query_id", (F.col("gold_sql") == F.col("pred_sql")).alias("exact"))


_REPORT = o.with_(label_pairs=LABEL_PAIRS_SQL) + """, c AS (SELECT class,
  sum(CASE WHEN side = 'g' AND label = pred THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN side = 'g' THEN 1 ELSE 0 END) AS support,
  sum(CASE WHEN side = 'p' THEN 1 ELSE 0 END) AS predicted FROM (SELECT label AS class, 'g' AS side, label, pred FROM label_pairs
  UNION ALL SELECT pred, 'p', label, pred FROM label_pairs) AS u GROUP BY class),
 s AS (SELECT class, tp, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM c),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s),
 r AS (SELECT class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM f
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r"""


@query("a23_classification_report", _REPORT)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, also the report of the column-typing run."""
    report = ops.classification_report(label_pairs(spark, sf_dir), "label", "pred")
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
