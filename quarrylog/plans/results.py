"""Result-set comparison and the outcome of workload runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.functions import sqltext
from quarrylog.inputs import (
    CACHED_RESULTS_SQL, LARGE_QUERIES_SQL, LARGE_RESULTS_SQL, RESULT_ROWS_SQL, RUN_STATUS_SQL, SMALL_QUERIES_SQL, SMALL_RESULTS_SQL,
    cached_results, large_results, query_log, result_rows, run_status, small_results,
)
from quarrylog.operators import results, scoring
from quarrylog.plans.scoring import SETS
from quarrylog.registry import query

RR = o.with_(result_rows=RESULT_ROWS_SQL)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_rows(spark, sf_dir).select("query_id", "side", F.array("c0", "c1", "c2").alias("values"))


def _cells(found: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    found, asked = found
    return found.select("query_id", "side", "gold_no", F.array("c0", "c1").alias("values")), asked


def compared_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.compare_results(*_cells(small_results(spark, sf_dir)))


_PRESENCE = ", p AS (SELECT query_id, c0, c1, c2, count(*) FILTER (side = 'gold') AS g, count(*) FILTER (side = 'pred') AS r FROM result_rows GROUP BY ALL)"


@query("e6_execution_scores", RR + _PRESENCE + """, n AS (SELECT query_id, count(*) FILTER (g > 0 AND r > 0) AS tp, count(*) FILTER (g = 0) AS fp,
  count(*) FILTER (r = 0) AS fn FROM p GROUP BY query_id)
SELECT query_id, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, fp = 0 AND fn = 0 AS accuracy FROM n""")
def execution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = results.execution_scores(rows(spark, sf_dir))
    return scores.select("query_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "accuracy")


@query("a17_macro_summary", RR + _PRESENCE + """, n AS (SELECT query_id, count(*) FILTER (g > 0 AND r > 0) AS tp, count(*) FILTER (g = 0) AS fp,
  count(*) FILTER (r = 0) AS fn FROM p GROUP BY query_id)
SELECT round(avg(CASE WHEN fp = 0 AND fn = 0 THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(tp / (tp + fn)), 6) AS recall,
  round(avg(tp / (tp + fp)), 6) AS precision, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS f1 FROM n""")
def macro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 over result rows."""
    summary = scoring.macro_summary(results.execution_scores(rows(spark, sf_dir)))
    return summary.select(*[F.round(c, 6).alias(c) for c in summary.columns])


_CELLS = """, d AS (SELECT DISTINCT query_id, side, c0, c1, c2 FROM result_rows),
 v AS (SELECT DISTINCT query_id, side, 0 AS col, c0 AS value FROM d UNION ALL SELECT DISTINCT query_id, side, 1, c1 FROM d
   UNION ALL SELECT DISTINCT query_id, side, 2, c2 FROM d),
 o AS (SELECT g.query_id, g.col AS gold_col, p.col AS pred_col, count(*) AS common FROM v g JOIN v p
   ON g.query_id = p.query_id AND g.value IS NOT DISTINCT FROM p.value AND g.side = 'gold' AND p.side = 'pred' GROUP BY ALL),
 gr AS (SELECT query_id, count(*) AS gold_rows FROM d WHERE side = 'gold' GROUP BY query_id)"""


@query("e7_column_overlap", RR + _CELLS + """SELECT query_id, gold_col, pred_col, round(common / gold_rows, 6) AS overlap FROM o JOIN gr USING (query_id)""")
def column_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = results.distinct_rows(rows(spark, sf_dir))
    gold_rows = results.result_shape(distinct).select("query_id", "gold_rows")
    joined = results.column_overlaps(distinct).join(gold_rows, "query_id")
    return joined.select("query_id", "gold_col", "pred_col", F.round(F.col("common") / F.col("gold_rows"), 6).alias("overlap"))


# Three columns a side: the six one-to-one assignments, written out; the best is the first in column order.
_ASSIGN = _CELLS + """, perm AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) AS t(a, b, c)),
 w AS (SELECT q.query_id, a, b, c,
   coalesce((SELECT common FROM o WHERE o.query_id = q.query_id AND pred_col = 0 AND gold_col = a), 0)
   + coalesce((SELECT common FROM o WHERE o.query_id = q.query_id AND pred_col = 1 AND gold_col = b), 0)
   + coalesce((SELECT common FROM o WHERE o.query_id = q.query_id AND pred_col = 2 AND gold_col = c), 0) AS total
   FROM gr q JOIN perm ON true),
 best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, a, b, c) = 1)"""


@query("e8_column_matching", RR + _ASSIGN + "SELECT query_id, concat(a, ',', b, ',', c) AS matched, CAST(total AS BIGINT) AS common FROM best")
def column_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = results.distinct_rows(rows(spark, sf_dir))
    matching = results.best_matching(results.column_overlaps(distinct), results.result_shape(distinct))
    return matching.select("query_id", F.array_join(F.col("matched").cast("array<string>"), ",").alias("matched"), "common")


_OUTPUT = _ASSIGN + """, m AS (SELECT DISTINCT query_id, x, y, z FROM (SELECT d.query_id,
   CASE a WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS x, CASE b WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS y,
   CASE c WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS z FROM d JOIN best USING (query_id) WHERE side = 'gold') AS g),
 hit AS (SELECT m.query_id, count(*) AS n FROM m JOIN d ON d.side = 'pred' AND d.query_id = m.query_id AND c0 = x AND c1 = y AND c2 = z GROUP BY 1)"""


@query("e9_entry_accuracy", RR + _ASSIGN + """SELECT round(avg(total * 100 / (gold_rows * 3)), 6) AS entry_accuracy FROM best JOIN gr USING (query_id)""")
def entry_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = results.distinct_rows(rows(spark, sf_dir))
    shape = results.result_shape(distinct)
    matching = results.best_matching(results.column_overlaps(distinct), shape)
    scores = shape.select("query_id").join(results.entry_accuracy(matching), "query_id", "left")
    return scores.agg(F.round(F.avg(F.coalesce("entry_accuracy", F.lit(0.0))), 6).alias("entry_accuracy"))


@query("e10_output_accuracy", RR + _OUTPUT + """SELECT query_id, round(total * 100 / (gold_rows * 3), 6) AS entry_accuracy,
  round(coalesce(n, 0) * 100 / gold_rows, 6) AS output_accuracy FROM best JOIN gr USING (query_id) LEFT JOIN hit USING (query_id)""")
def output_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = results.entry_and_output_accuracy(rows(spark, sf_dir))
    return scores.select("query_id", *[F.round(c, 6).alias(c) for c in ("entry_accuracy", "output_accuracy")])


@query("e11_best_of_golds", o.with_(**{k: v for k, v in SETS.items() if k not in ("counts", "ratio", "scores")}) + f""",
 alt AS (SELECT query_id, tabs, p_tabs FROM p_refs UNION ALL SELECT query_id, list_distinct(list_append(tabs, 'REGION')), p_tabs FROM p_refs),
 counts AS (SELECT *, {o.score_columns('tabs', 'p_tabs')} FROM alt), ratio AS (SELECT *, {o.RATIOS} FROM counts)
SELECT query_id, max(acc) AS accuracy, round(max(p), 6) AS precision, round(max(r), 6) AS recall,
  round(max(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 6) AS f1 FROM ratio GROUP BY query_id""")
def best_of_golds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two golds per query: its tables, and its tables with one more."""
    sets = query_log(spark, sf_dir).select(
        "query_id", sqltext.table_refs(F.col("gold_sql")).alias("g"), sqltext.table_refs(F.col("pred_sql")).alias("p")
    )
    more = F.array_union("g", F.array(F.lit("REGION")))
    alternatives = sets.select("query_id", F.explode(F.array("g", more)).alias("g"), "p")
    scores = results.best_of_golds(scoring.set_scores(alternatives, ["query_id"], F.col("g"), F.col("p")), ["query_id"])
    return scores.select("query_id", "accuracy", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _compared(found: str, asked: str) -> str:
    return o.with_(found=found, asked=asked) + """, g AS (SELECT query_id, gold_no, c0, c1, count(*) AS n FROM found WHERE side = 'gold' GROUP BY ALL),
 a AS (SELECT query_id, failed, unnest(range(n_golds)) AS gold_no FROM asked),
 p AS (SELECT query_id, c0, c1, count(*) AS n FROM found WHERE side = 'pred' GROUP BY ALL),
 q AS (SELECT query_id, gold_no, c0, c1, n FROM a JOIN p USING (query_id)),
 m AS (SELECT query_id, gold_no, c0, c1, coalesce(g.n, 0) AS gn, coalesce(q.n, 0) AS pn FROM g FULL JOIN q USING (query_id, gold_no, c0, c1)),
 s AS (SELECT a.query_id, a.gold_no, a.failed, CAST(coalesce(sum(gn), 0) AS BIGINT) AS gold_size, CAST(coalesce(sum(pn), 0) AS BIGINT) AS n_pred,
   count(*) FILTER (gn > 0 AND pn = 0) AS missing, count(*) FILTER (gn <> pn) AS unequal, max(c0) FILTER (gn > 0) AS gc, max(c0) FILTER (pn > 0) AS pc
   FROM a LEFT JOIN m ON a.query_id = m.query_id AND a.gold_no = m.gold_no GROUP BY a.query_id, a.gold_no, a.failed),
 x AS (SELECT query_id, CAST(gold_no AS BIGINT) AS gold_no, failed, gold_size, CASE WHEN NOT failed THEN n_pred END AS pred_size, missing, unequal,
   CASE WHEN failed OR gold_size <> n_pred THEN false WHEN n_pred = 0 THEN true WHEN n_pred = 1 THEN gc = pc
     WHEN n_pred <= 10 THEN missing = 0 ELSE unequal = 0 END AS correct FROM s),
 y AS (SELECT query_id, bool_or(failed) AS failed, max(pred_size) AS pred_size, bool_or(coalesce(gold_size = pred_size, false)) AS same_size,
   bool_or(correct) AS correct, bool_or(correct AND gold_no = 0) AS by_first_gold FROM x GROUP BY query_id)
"""


_SMALL = _compared(SMALL_RESULTS_SQL, SMALL_QUERIES_SQL)


@query("e13_size_gate", _SMALL + "SELECT query_id, failed, same_size FROM y")
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.best_comparison(compared_small(spark, sf_dir)).select("query_id", "failed", "same_size")


@query("e14_one_value", _SMALL + "SELECT query_id, correct, by_first_gold FROM y WHERE same_size AND pred_size = 1")
def one_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = results.best_comparison(compared_small(spark, sf_dir))
    return best.where("same_size AND pred_size = 1").select("query_id", "correct", "by_first_gold")


@query("e15_small_results", _SMALL + "SELECT query_id, gold_no, gold_size, pred_size, missing, correct FROM x WHERE pred_size <= 10")
def small_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = compared_small(spark, sf_dir).where("pred_size <= 10")
    return kept.select("query_id", F.col("gold_no").cast("long").alias("gold_no"), "gold_size", "pred_size", "missing", "correct")


@query(
    "e16_large_results",
    _compared(LARGE_RESULTS_SQL, LARGE_QUERIES_SQL) + "SELECT query_id, gold_no, gold_size, pred_size, unequal, correct FROM x WHERE pred_size > 10",
)
def large_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = results.compare_results(*_cells(large_results(spark, sf_dir))).where("pred_size > 10")
    return kept.select("query_id", F.col("gold_no").cast("long").alias("gold_no"), "gold_size", "pred_size", "unequal", "correct")


@query("a28_output_sizes", o.with_(found=SMALL_RESULTS_SQL, asked=SMALL_QUERIES_SQL) + """SELECT a.query_id, count(*) FILTER (side = 'gold' AND gold_no = 0) AS gold_size,
  CASE WHEN NOT failed THEN count(*) FILTER (side = 'pred') END AS pred_size FROM asked a LEFT JOIN found USING (query_id) GROUP BY a.query_id, failed""")
def output_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.output_sizes(*_cells(small_results(spark, sf_dir)))


@query("a29_size_report", _SMALL + """SELECT count(*) AS total, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT failed AND NOT same_size) AS wrong_size,
  count(*) FILTER (same_size AND pred_size > 0) AS same_size,
  count(*) FILTER (same_size AND pred_size = 1) AS n_one, count(*) FILTER (same_size AND pred_size BETWEEN 2 AND 10) AS n_small,
  count(*) FILTER (same_size AND pred_size = 0) AS n_empty, count(*) FILTER (same_size AND pred_size > 10) AS n_large,
  count(*) FILTER (correct AND pred_size = 1) AS correct_one, count(*) FILTER (correct AND pred_size BETWEEN 2 AND 10) AS correct_small,
  count(*) FILTER (correct AND pred_size = 0) AS correct_empty, count(*) FILTER (correct AND pred_size > 10) AS correct_large,
  count(*) FILTER (correct) AS correct, count(*) FILTER (correct AND NOT by_first_gold) AS correct_by_other_gold FROM y""")
def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.size_report(compared_small(spark, sf_dir))


@query("a27_error_percentage", o.with_(status=RUN_STATUS_SQL) + "SELECT round(count(error) * 100.0 / count(*), 6) AS error_percentage FROM status")
def error_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the status of every statement of the log."""
    return results.error_percentage(run_status(spark, sf_dir)).select(F.round("error_percentage", 6).alias("error_percentage"))


@query("a27_error_percentage_cached", o.with_(status=RUN_STATUS_SQL, cached=CACHED_RESULTS_SQL) + """SELECT round(count(error) FILTER (
  query_id NOT IN (SELECT query_id FROM cached WHERE n_rows > 0)) * 100.0 / count(*), 6) AS error_percentage FROM status""")
def error_percentage_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27 where a cached result with rows stands for a success."""
    found = results.error_percentage(run_status(spark, sf_dir), cached_results(spark, sf_dir))
    return found.select(F.round("error_percentage", 6).alias("error_percentage"))
