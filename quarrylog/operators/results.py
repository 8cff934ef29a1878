"""Comparing the result rows of predicted and gold queries.

Rows come as ``(query_id, side, values)``: side is ``gold`` or ``pred`` and
``values`` an array of cell texts, null cells allowed. A query whose run
failed has no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarrylog.functions.scores import ratios
from quarrylog.operators.joins import spread_join
from quarrylog.session import cut_lineage


def is_gold() -> Column:
    return F.col("side") == "gold"


def row_presence(rows: DataFrame) -> DataFrame:
    """One row per distinct result row of a query, with the number of times each side holds it."""
    return rows.groupBy("query_id", "values").agg(
        F.count_if(is_gold()).alias("in_gold"), F.count_if(~is_gold()).alias("in_pred")
    )


def execution_scores(rows: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """E1 over distinct result rows; queries without any rows count as two empty sets."""
    gold, pred = F.col("in_gold") > 0, F.col("in_pred") > 0
    counts = row_presence(rows).groupBy("query_id").agg(
        F.count_if(gold & pred).alias("tp"), F.count_if(~gold).alias("fp"), F.count_if(~pred).alias("fn")
    )
    if queries is not None:
        counts = queries.select("query_id").join(counts, "query_id", "left").na.fill(0, ["tp", "fp", "fn"])
    scored = ratios(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("query_id", "tp", "fp", "fn", *[c.alias(n) for n, c in scored.items()])


def distinct_rows(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "side", "values").dropDuplicates()


def result_shape(distinct: DataFrame) -> DataFrame:
    """Distinct rows and width of each side."""
    return distinct.groupBy("query_id").agg(
        F.count_if(is_gold()).alias("gold_rows"),
        F.count_if(~is_gold()).alias("pred_rows"),
        F.max(F.when(is_gold(), F.size("values"))).alias("gold_width"),
        F.max(F.when(~is_gold(), F.size("values"))).alias("pred_width"),
    )


def column_overlaps(distinct: DataFrame) -> DataFrame:
    """Common distinct values of every gold/pred column pair that shares any.

    A value meets only the columns that hold it: grouped on (query, value), the
    two column lists are no longer than the result is wide.
    """
    cells = distinct.select("query_id", "side", F.posexplode("values").alias("col", "value"))
    holders = cells.groupBy("query_id", "value").agg(
        F.collect_set(F.when(is_gold(), F.col("col"))).alias("gold_cols"),
        F.collect_set(F.when(~is_gold(), F.col("col"))).alias("pred_cols"),
    )
    pairs = holders.select("query_id", F.explode("gold_cols").alias("gold_col"), "pred_cols").select(
        "query_id", "gold_col", F.explode("pred_cols").alias("pred_col")
    )
    return pairs.groupBy("query_id", "gold_col", "pred_col").agg(F.count("*").alias("common"))


def assign(weights: list[list[int]]) -> list[int]:
    """Column of each row in a one-to-one assignment of largest total weight, rows <= columns.

    Shortest augmenting paths on whole numbers. Among equal totals the
    assignment that is smallest in column order wins: a tie term below the
    weight of one unit favours low columns, first rows first.
    """
    n, m = len(weights), len(weights[0])
    unit = (m + 1) ** (n + 1)
    cost = [
        [-(weights[i][j] * unit + (m - j) * (m + 1) ** (n - 1 - i)) for j in range(m)] for i in range(n)
    ]
    big = sum(abs(c) for line in cost for c in line) + 1
    row_price, col_price, owner = [0] * n, [0] * m, [-1] * m
    for start in range(n):
        slack, via, done = [big] * m, [-1] * m, [False] * m
        row, last = start, -1
        while True:
            for j in range(m):
                if not done[j]:
                    reduced = cost[row][j] - row_price[row] - col_price[j]
                    if reduced < slack[j]:
                        slack[j], via[j] = reduced, last
            nearest = min((j for j in range(m) if not done[j]), key=lambda j: slack[j])
            step = slack[nearest]
            row_price[start] += step
            for j in range(m):
                if done[j]:
                    row_price[owner[j]] += step
                    col_price[j] -= step
                else:
                    slack[j] -= step
            done[nearest], last = True, nearest
            if owner[nearest] < 0:
                break
            row = owner[nearest]
        while last >= 0:
            previous = via[last]
            owner[last] = owner[previous] if previous >= 0 else start
            last = previous
    chosen = [0] * n
    for j, i in enumerate(owner):
        if i >= 0:
            chosen[i] = j
    return chosen


_MATCH = T.StructType(
    [T.StructField("matched", T.ArrayType(T.IntegerType())), T.StructField("common", T.LongType())]
)


@F.pandas_udf(_MATCH)
def _matched(cells: pd.Series, gold_width: pd.Series, pred_width: pd.Series) -> pd.DataFrame:
    """Columns matched per query, from its non-zero cells ``(gold_col, pred_col, common)``."""
    found = []
    for own, gold, pred in zip(cells, gold_width, pred_width):
        weights = [[0] * max(gold, pred) for _ in range(min(gold, pred))]
        for cell in own:
            i, j = (cell["gold_col"], cell["pred_col"]) if gold < pred else (cell["pred_col"], cell["gold_col"])
            weights[i][j] = int(cell["common"])
        chosen = assign(weights)
        found.append((chosen, sum(weights[i][j] for i, j in enumerate(chosen))))
    return pd.DataFrame(found, columns=["matched", "common"])


def best_matching(overlaps: DataFrame, shape: DataFrame) -> DataFrame:
    """Per query the matched column of the wider side for each column of the narrower one.

    The prediction is the narrower side on equal widths. A list holds one cell
    per column pair, never result rows, and many queries share one Arrow batch.
    """
    cells = overlaps.groupBy("query_id").agg(F.collect_list(F.struct("gold_col", "pred_col", "common")).alias("cells"))
    both = shape.where("gold_rows > 0 AND pred_rows > 0").join(cells, "query_id", "left")
    none = F.expr("CAST(array() AS array<struct<gold_col:int,pred_col:int,common:bigint>>)")
    best = both.withColumn("best", _matched(F.coalesce("cells", none), "gold_width", "pred_width"))
    return best.select(
        "query_id",
        (F.col("gold_width") < F.col("pred_width")).alias("gold_is_min"),
        "best.matched",
        "best.common",
        "gold_rows",
        (F.col("gold_rows") + F.col("pred_rows")).alias("n_rows"),
    )


def entry_accuracy(matching: DataFrame) -> DataFrame:
    """E9 per query: mean overlap of matched columns, in percent of the distinct gold rows."""
    share = F.col("common") * 100 / (F.col("gold_rows") * F.size("matched"))
    return matching.select("query_id", share.alias("entry_accuracy"))


def output_accuracy(distinct: DataFrame, matching: DataFrame) -> DataFrame:
    """E10 per query: common distinct rows after the wider side is cut to its matched columns."""
    placed = spread_join(distinct, matching, ["query_id"], ["values"], n="n_rows")
    is_min = F.col("gold_is_min") == is_gold()
    projected = F.when(is_min, F.col("values")).otherwise(
        F.transform("matched", lambda j: F.col("values")[j])
    )
    rows = placed.select("query_id", "side", "gold_rows", projected.alias("values"))
    seen = rows.groupBy("query_id", "values").agg(
        F.max(is_gold()).alias("g"), F.max(~is_gold()).alias("p"), F.first("gold_rows").alias("gold_rows")
    )
    return seen.groupBy("query_id").agg(
        (F.count_if(F.col("g") & F.col("p")) * 100 / F.first("gold_rows")).alias("output_accuracy")
    )


def entry_and_output_accuracy(rows: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """E9 and E10 for every query; a side without rows scores 0."""
    distinct = cut_lineage(distinct_rows(rows))
    shape = result_shape(distinct)
    matching = cut_lineage(best_matching(column_overlaps(distinct), shape))
    every = shape.select("query_id") if queries is None else queries.select("query_id")
    return (
        every.join(entry_accuracy(matching), "query_id", "left")
        .join(output_accuracy(distinct, matching), "query_id", "left")
        .na.fill(0.0, ["entry_accuracy", "output_accuracy"])
    )


def _counted(rows: DataFrame) -> DataFrame:
    """Per (query, number): size, distinct rows, and how they meet the prediction; number -1 is the prediction itself."""
    number = F.when(is_gold(), F.col("gold_no")).otherwise(-1)
    copies = rows.groupBy("query_id", "values", number.alias("number")).agg(F.count("*").alias("n"))
    # One entry per gold that holds the row: as long as a query has golds, however often a row repeats.
    held = copies.groupBy("query_id", "values").agg(F.map_from_entries(F.collect_list(F.struct("number", "n"))).alias("held"))
    in_pred = F.coalesce(F.try_element_at("held", F.lit(-1)), F.lit(0))
    each = held.select("query_id", "values", in_pred.alias("in_pred"), F.explode("held").alias("number", "n"))
    return each.groupBy("query_id", "number").agg(
        F.sum("n").alias("size"),
        F.count("*").alias("n_distinct"),
        F.count_if(F.col("in_pred") == 0).alias("missing"),
        F.count_if(F.col("in_pred") != F.col("n")).alias("differ"),
        F.max(F.struct(F.get("values", F.lit(0)).alias("v"))).alias("cell"),
    )


def compare_results(rows: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """E13-E16 per query and alternative gold: sizes, and the verdict of the test that fits the size.

    Both empty: right. One row: its first cell must agree. Up to 10: every gold
    row must be in the prediction. More: both sides must hold the same rows
    equally often. A failed run has no size and is wrong.

    ``rows`` may number several golds of a query from 0 in ``gold_no``.
    ``queries`` is ``(query_id, n_golds, failed)``; queries without any row are
    compared too. By default every query that has rows ran.
    """
    if "gold_no" not in rows.columns:
        rows = rows.withColumn("gold_no", F.lit(0))
    if queries is None:
        last = F.max(F.when(is_gold(), F.col("gold_no")))
        queries = rows.groupBy("query_id").agg(F.coalesce(last + 1, F.lit(1)).alias("n_golds"), F.lit(False).alias("failed"))
    counted = _counted(rows)
    gold = counted.where("number >= 0").select(
        "query_id", F.col("number").alias("gold_no"), F.col("size").alias("gold_size"), F.col("cell").alias("gold_cell"),
        "missing", "differ", (F.col("n_distinct") - F.col("missing")).alias("shared"),
    )
    pred = counted.where("number = -1").select(
        "query_id", F.col("size").alias("_size"), F.col("n_distinct").alias("_distinct"), F.col("cell").alias("pred_cell")
    )
    asked = queries.select("query_id", "failed", F.explode(F.sequence(F.lit(0), F.col("n_golds") - 1)).alias("gold_no"))
    both = asked.join(gold, ["query_id", "gold_no"], "left").join(pred, "query_id", "left")
    both = both.na.fill(0, ["gold_size", "missing", "differ", "shared", "_size", "_distinct"])
    size = F.col("_size")
    unequal = F.col("differ") + F.col("_distinct") - F.col("shared")
    verdict = (
        F.when(F.col("failed") | (F.col("gold_size") != size), False)
        .when(size == 0, True)
        .when(size == 1, F.col("gold_cell").eqNullSafe(F.col("pred_cell")))
        .when(size <= 10, F.col("missing") == 0)
        .otherwise(unequal == 0)
    )
    return both.select(
        "query_id", "gold_no", "failed", "gold_size", F.when(~F.col("failed"), size).alias("pred_size"),
        "missing", unequal.alias("unequal"), verdict.alias("correct"),
    )


def best_comparison(compared: DataFrame) -> DataFrame:
    """One row per query: any of its golds may agree in size and be matched."""
    same = F.coalesce(F.col("gold_size") == F.col("pred_size"), F.lit(False))
    return compared.groupBy("query_id").agg(
        F.bool_or("failed").alias("failed"),
        F.max("pred_size").alias("pred_size"),
        F.bool_or(same).alias("same_size"),
        F.bool_or("correct").alias("correct"),
        F.bool_or(F.col("correct") & (F.col("gold_no") == 0)).alias("by_first_gold"),
    )


def output_sizes(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of the first gold and of the prediction; a failed run has no size."""
    sizes = rows.groupBy("query_id").agg(
        F.count_if(is_gold() & (F.col("gold_no") == 0)).alias("gold_size"), F.count_if(~is_gold()).alias("pred_size")
    )
    every = queries.select("query_id", "failed").join(sizes, "query_id", "left").na.fill(0, ["gold_size", "pred_size"])
    return every.select("query_id", "gold_size", F.when(~F.col("failed"), F.col("pred_size")).alias("pred_size"))


def size_report(compared: DataFrame) -> DataFrame:
    """Queries by size class and how many of each are correct."""
    size, same = F.col("pred_size"), F.col("same_size")
    classes = {"one": size == 1, "small": (size > 1) & (size <= 10), "empty": size == 0, "large": size > 10}
    return best_comparison(compared).agg(
        F.count("*").alias("total"),
        F.count_if("failed").alias("failed"),
        F.count_if(~F.col("failed") & ~same).alias("wrong_size"),
        F.count_if(same & (size > 0)).alias("same_size"),
        *[F.count_if(same & c).alias(f"n_{n}") for n, c in classes.items()],
        *[F.count_if(F.col("correct") & c).alias(f"correct_{n}") for n, c in classes.items()],
        F.count_if("correct").alias("correct"),
        F.count_if(F.col("correct") & ~F.col("by_first_gold")).alias("correct_by_other_gold"),
    )


def error_percentage(status: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """Share of statements with an ``error``, in percent; null without statements.

    With ``cached`` (``query_id, n_rows`` of earlier results) a statement that has
    a cached result with rows counts as a success.
    """
    if cached is not None:
        answered = cached.where("n_rows > 0").select("query_id", F.lit(True).alias("_answered")).dropDuplicates(["query_id"])
        status = status.join(answered, "query_id", "left").withColumn("error", F.when(F.col("_answered").isNull(), F.col("error")))
    return status.agg(F.try_divide(F.count("error") * 100.0, F.count("*")).alias("error_percentage"))


def best_of_golds(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per candidate the best value of each metric over its alternative golds.

    An exact match holds the largest value of every metric, so the plain
    maximum also covers the rule that such a gold decides alone.
    """
    return scores.groupBy(*keys).agg(
        F.max("accuracy").alias("accuracy"), *[F.max(n).alias(n) for n in ("precision", "recall", "f1")]
    )
