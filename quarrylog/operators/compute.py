"""Expensive columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each worked out once per row however often it is used.

    Filters on a plain computed column are pushed below it with the expression
    copied, which runs costly text work twice. A one-row generator holds them
    back; filters on the other columns still go down.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", packed.alias("_once")).select(*df.columns, "_once.*")
