"""Set scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratios(tp: Column, fp: Column, fn: Column, empty_precision: float = 1.0) -> dict[str, Column]:
    """Precision, recall, F1 and equality from counts.

    Precision is ``empty_precision`` if nothing was predicted, recall 0 without
    gold, F1 0 when both ratios are 0.
    """
    precision = F.when(tp + fp == 0, F.lit(empty_precision)).otherwise(tp / (tp + fp))
    recall = F.when(tp + fn == 0, F.lit(0.0)).otherwise(tp / (tp + fn))
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
    return {"precision": precision, "recall": recall, "f1": f1, "accuracy": (fp == 0) & (fn == 0)}


def set_counts(gold: Column, pred: Column) -> dict[str, Column]:
    """Sizes of intersection and differences of two distinct arrays."""
    tp = F.size(F.array_intersect(gold, pred)).cast("long")
    return {"tp": tp, "fp": F.size(pred) - tp, "fn": F.size(gold) - tp}


def overlap_ratio(a: Column, b: Column) -> Column:
    """U8: shared / larger size."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def table_overlap(a: Column, b: Column) -> Column:
    """V4: shared tables, less the size difference relative to ``a`` when sizes differ."""
    return F.size(F.array_intersect(a, b)) - F.abs(F.size(a) - F.size(b)) / F.size(a)
