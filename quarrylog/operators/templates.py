"""Template grouping and near-duplicate templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrylog.functions import sqltext


def template_groups(log: DataFrame, sql: str, key: str) -> DataFrame:
    """A10: one row per literal-masked template, with its size and first member.

    Members are not collected: a template may hold a third of the log.
    ``template_members`` is the long form of the list.
    """
    return (
        log.select(sqltext.mask_literals(F.col(sql)).alias("template"), F.col(key).alias("_key"))
        .groupBy("template")
        .agg(F.count("*").alias("n_queries"), F.min("_key").alias(f"first_{key}"))
    )


def template_members(log: DataFrame, sql: str, key: str) -> DataFrame:
    """A10, long form: (template id, member)."""
    return log.select(F.sha2(sqltext.mask_literals(F.col(sql)), 256).alias("template_id"), key)
