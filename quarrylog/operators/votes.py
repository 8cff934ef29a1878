"""Votes over repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def majority_vote(runs: DataFrame, question: str, run: str, prediction: str) -> DataFrame:
    """Most frequent prediction per question, ties to the one seen first."""
    counts = runs.groupBy(question, prediction).agg(F.count("*").alias("votes"), F.min(run).alias("first_run"))
    # Two aggregations with map-side combine; no window over a question's runs.
    best = counts.groupBy(question).agg(
        F.max_by(F.struct(prediction, "votes", "first_run"), F.struct("votes", -F.col("first_run"))).alias("best")
    )
    return best.select(question, "best.*")


def three_run_vote(first: Column, second: Column, third: Column) -> Column:
    """Two equal answers win, otherwise the last run."""
    return F.when(first.eqNullSafe(second) | first.eqNullSafe(third), first).when(second.eqNullSafe(third), second).otherwise(third)


def split_questions(runs: DataFrame, question: str, prediction: str, answers: int) -> DataFrame:
    """Questions with exactly ``answers`` different predictions."""
    distinct = runs.groupBy(question, prediction).agg(F.lit(1))
    return distinct.groupBy(question).agg(F.count("*").alias("n_answers")).where(F.col("n_answers") == answers)
