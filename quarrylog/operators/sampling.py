"""Seeded samples that are the same on every run and every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.operators.joins import first_per_group
from quarrylog.session import cut_lineage


def seeded_order(seed: int, key: Column) -> Column:
    """Position of a row in the shuffle that ``seed`` stands for."""
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows without replacement."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def quota_sample(df: DataFrame, key: str, level: str, quota: dict[str, int], seed: int) -> DataFrame:
    """Up to ``quota[level]`` rows of each level; levels without a quota give none."""
    wanted = df.where(F.col(level).isin([name for name, n in quota.items() if n > 0]))
    ranked = first_per_group(
        wanted.withColumn("_h", seeded_order(seed, F.col(key))), [level], ["_h", key], max(quota.values()), "_rank"
    )
    allowed = F.coalesce(*[F.when(F.col(level) == name, F.lit(n)) for name, n in quota.items()])
    return ranked.where(F.col("_rank") <= allowed).drop("_h", "_rank")


def proportional_quota(df: DataFrame, level: str, n: int) -> DataFrame:
    """Round-half-even share of ``n`` per level, at least 1; the largest level takes the rounding error."""
    # One row per level, read four times below: the rows themselves are counted once.
    counts = cut_lineage(df.groupBy(level).agg(F.count("*").alias("size")))
    total = counts.agg(F.sum("size")).scalar()
    largest = counts.agg(F.max_by(level, F.struct("size", level))).scalar()
    quota = counts.withColumn("quota", F.greatest(F.lit(1), F.bround(F.col("size") * n / total).cast("int")))
    rest = F.lit(n) - quota.agg(F.sum("quota")).scalar()
    fixed = F.when(F.col(level) == largest, F.col("quota") + rest).otherwise(F.col("quota"))
    return quota.select(level, "size", fixed.cast("int").alias("quota"))


def proportional_sample(df: DataFrame, key: str, level: str, n: int, seed: int) -> DataFrame:
    """Proportional stratified sample."""
    ranked = first_per_group(
        df.withColumn("_h", seeded_order(seed, F.col(key))), [level], ["_h", key], n, "_rank"
    )
    quota = proportional_quota(df, level, n).select(level, "quota")
    return ranked.join(quota, level).where("_rank <= quota").drop("_h", "_rank", "quota")


def head_and_tail(df: DataFrame, order: str, n: int, seed: int) -> DataFrame:
    """First and last ``n`` rows, each part shuffled; rows in both parts appear once."""
    head = df.orderBy(F.asc(order)).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(F.desc(order)).limit(n).withColumn("part", F.lit("tail"))
    # At most 2n rows from here on.
    both = head.unionByName(tail).groupBy(*df.columns).agg(F.min("part").alias("part"))
    return both.orderBy("part", seeded_order(seed, F.col(order)))
