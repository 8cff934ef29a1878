"""Earlier queries chosen as context for a prompt."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylog.operators.joins import first_per_group
from quarrylog.operators.sequence import ordered, runs, with_previous
from quarrylog.session import cut_lineage


def shortest_per_table(log: DataFrame, key: str, sql: str, tables: Column) -> DataFrame:
    """The shortest query of each table, ties by key."""
    rows = log.select(key, F.length(sql).alias("n"), F.explode(tables).alias("table_name"))
    return rows.groupBy("table_name").agg(F.min_by(key, F.struct("n", key)).alias(key))


def _entered_tables(taken: DataFrame, scope: str, budget: int) -> DataFrame:
    """Tables reached before the budget ran out; it is looked at only when a table is entered."""
    sizes = taken.groupBy(scope, "table_name").agg(F.count("*").alias("n"))
    window = Window.partitionBy(scope).orderBy("table_name").rowsBetween(Window.unboundedPreceding, -1)
    spent = sizes.withColumn("spent", F.coalesce(F.sum("n").over(window), F.lit(0)))
    return spent.where(F.col("spent") < budget).select(scope, "table_name")


def table_log(log: DataFrame, key: str, scope: str, sql: str, tables: Column, cap: int, budget: int) -> DataFrame:
    """W7 with repeats: per scope and table the ``cap`` shortest queries, tables by name, under one budget."""
    rows = log.select(key, scope, F.length(sql).alias("n_chars"), F.explode(tables).alias("table_name"))
    taken = first_per_group(rows, [scope, "table_name"], ["n_chars", key], cap)
    return taken.join(_entered_tables(taken, scope, budget), [scope, "table_name"]).select(scope, "table_name", "rank", key)


TABLES_PER_BLOCK = 32


def table_log_once(log: DataFrame, key: str, scope: str, sql: str, tables: Column, cap: int, budget: int, block: int = TABLES_PER_BLOCK) -> DataFrame:
    """W7 without repeats: a SQL text goes to the first table that takes it.

    The walk goes over the tables of a scope in blocks of ``block`` tables. What
    passes from block to block is the state of the walk: the texts in use (taken out
    of the candidates by a join), the budget left and the last table entered. A
    block holds only tables with an unused text, so its first table takes one, and a
    scope needs ``budget`` blocks at most. At most ``budget - 1 + cap`` texts are ever
    taken in a scope, so a table needs no more than that many plus ``cap``
    candidates, and a task never sees more than ``block`` times that of one scope.
    """
    spark, reach = log.sparkSession, 2 * cap + budget
    rows = log.select(key, scope, F.length(sql).alias("n_chars"), F.md5(sql).alias("text_key"), F.explode(tables).alias("table_name"))
    distinct = rows.groupBy(scope, "table_name", "text_key").agg(F.min(F.struct("n_chars", key)).alias("first"))
    short = distinct.select(scope, "table_name", "text_key", "first.*")
    left = cut_lineage(first_per_group(short, [scope, "table_name"], ["n_chars", key], reach).withColumn("budget", F.lit(budget)))
    schema = f"{scope} string, table_name string, rank int, {key} {dict(log.dtypes)[key]}, text_key string, budget int, last string"

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        budget, used, out = int(frame["budget"].iloc[0]), set(), []
        for name, candidates in frame.sort_values(["table_name", "rank"]).groupby("table_name", sort=True):
            if budget <= 0:
                break
            fresh = candidates[~candidates["text_key"].isin(used)].head(cap)
            used.update(fresh["text_key"])
            budget -= len(fresh)
            out.append(fresh.assign(rank=range(1, len(fresh) + 1)))
        return pd.concat(out).assign(budget=budget, last=frame["table_name"].max())[[scope, "table_name", "rank", key, "text_key", "budget", "last"]]

    done = spark.createDataFrame([], schema)
    for _ in range(budget):
        entered = first_per_group(left.select(scope, "table_name").distinct(), [scope], ["table_name"], block, "place").select(scope, "table_name")
        taken = cut_lineage(left.join(entered, [scope, "table_name"], "left_semi").groupBy(scope).applyInPandas(walk, schema))
        if taken.isEmpty():
            break
        done = done.unionByName(taken)
        state = taken.groupBy(scope).agg(F.first("budget").alias("_budget"), F.first("last").alias("_last")).where("_budget > 0")
        ahead = left.join(state, scope).where("table_name > _last").withColumn("budget", F.col("_budget")).select(left.columns)
        left = cut_lineage(ahead.join(taken.select(scope, "text_key"), [scope, "text_key"], "left_anti").select(left.columns))
    return done.select(scope, "table_name", "rank", key)


def drop_consecutive_repeats(log: DataFrame, key: str, group: str, sql: str) -> DataFrame:
    """Of two neighbours where one text holds the other, keep the first; the pair is then skipped.

    Inside a stretch of linked neighbours this keeps every second row.
    """
    seq = ordered(log.select(group, key, F.upper(sql).alias("_text")), [group, key])
    linked = with_previous(seq, ["_text"], [group])
    holds = F.col("_text").contains(F.col("prev__text")) | F.col("prev__text").contains(F.col("_text"))
    starts = F.col("_first") | ~holds
    return runs(linked, starts).where("offset % 2 = 0").select(group, key)


def consecutive_runs(df: DataFrame, order: str, value: str) -> DataFrame:
    """``run`` and ``offset`` of every row; a run is a stretch of equal neighbours.

    Long form of the regrouped lists: a run may be long, so its rows stay rows.
    """
    seq = ordered(df.select(order, value), [order])
    marked = with_previous(seq, [value])
    starts = F.col("_first") | ~F.col(value).eqNullSafe(F.col(f"prev_{value}"))
    return runs(marked, starts).select("run", "offset", order, value)


def step_durations(events: DataFrame, user: str, ts: str, key: str) -> DataFrame:
    """Seconds since the previous event of the same user."""
    seq = ordered(events.select(user, ts, key), [user, ts, key])
    marked = with_previous(seq, [ts], [user])
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"prev_{ts}").cast("timestamp"))
    return marked.select(user, key, (micros / 1e6).alias("seconds"))
