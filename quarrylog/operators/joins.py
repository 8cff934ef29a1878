"""Joins that stay whole when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def spread_join(
    rows: DataFrame,
    dims: DataFrame,
    keys: list[str],
    by: list[str],
    how: str = "inner",
    salts: int = 16,
    n: str | None = None,
    total: Column | None = None,
) -> DataFrame:
    """Join ``rows`` to ``dims`` (few rows per key) with frequent keys split over ``salts`` tasks.

    ``n`` names the column of ``dims`` that holds how many rows have the key.
    Then only keys with over a ``10 * salts``-th of all rows are split; there
    are fewer than ``10 * salts`` of those, so their list is broadcast. ``total``
    is the number of rows, by default the sum of ``n`` (one row of ``dims`` per
    key). Without ``n``, for a short ``dims``, every key is split.

    The salt is a hash of the row's ``by`` columns, so a task that runs again
    sends its rows to the same place. Adaptive execution still turns the join
    into a broadcast join when it has measured ``dims`` to be small.
    """
    salt = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if n is None:
        wide = dims.withColumn("_salt", F.explode(every))
        return rows.withColumn("_salt", salt).join(wide, [*keys, "_salt"], how).drop("_salt")
    total = dims.agg(F.sum(n)).scalar() if total is None else total
    marked = dims.withColumn("_hot", F.col(n) * (10 * salts) > total)
    frequent = marked.where("_hot").select(*keys, F.lit(True).alias("_is_hot")).distinct()
    salted = rows.join(F.broadcast(frequent), keys, "left").withColumn("_salt", F.when(F.col("_is_hot"), salt).otherwise(0))
    wide = marked.withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))))
    return salted.join(wide, [*keys, "_salt"], how).drop("_salt", "_hot", "_is_hot")


# Spark ranks before the shuffle only up to this many rows per group (spark.sql.optimizer.windowGroupLimitThreshold).
EARLY_RANK_LIMIT = 1000


def first_per_group(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """Top ``k`` rows per group; every task hands on at most ``k`` rows of a group, so a hot group stays small."""
    if k > EARLY_RANK_LIMIT:
        # Rank inside each input partition first, as Spark does by itself for a smaller k.
        early = Window.partitionBy("_from", *group).orderBy(*order)
        df = df.withColumn("_from", F.spark_partition_id())
        df = df.withColumn("_early", F.row_number().over(early)).where(F.col("_early") <= k).drop("_from", "_early")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
