"""Table, column and label scores of predictions against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.functions.scores import ratios, set_counts


def set_scores(df: DataFrame, keys: list[str], gold: Column, pred: Column, empty_precision: float = 1.0) -> DataFrame:
    """Counts and ratios of two distinct arrays per row; a null prediction is an empty set."""
    nothing = F.array().cast("array<string>")
    sets = df.select(*keys, F.coalesce(gold, nothing).alias("_g"), F.coalesce(pred, nothing).alias("_p"))
    counted = sets.select(*keys, *[c.alias(n) for n, c in set_counts(F.col("_g"), F.col("_p")).items()])
    scored = ratios(F.col("tp"), F.col("fp"), F.col("fn"), empty_precision)
    return counted.select(*keys, "tp", "fp", "fn", *[c.alias(n) for n, c in scored.items()])


def set_scores_null_rule(df: DataFrame, keys: list[str], gold: Column, pred: Column) -> DataFrame:
    """A null side scores zeros, two empty sides score ones, otherwise as E1."""
    sets = df.select(*keys, gold.alias("_g"), pred.alias("_p"))
    # The ratios name each count many times: columns of their own, so the sets meet once.
    counted = sets.select("*", *[c.alias(n) for n, c in set_counts(F.col("_g"), F.col("_p")).items()])
    scored = ratios(F.col("tp"), F.col("fp"), F.col("fn"))
    missing = F.col("_g").isNull() | F.col("_p").isNull()
    both_empty = (F.size("_g") == 0) & (F.size("_p") == 0)

    def ruled(value: Column) -> Column:
        return F.when(missing, F.lit(0.0)).when(both_empty, F.lit(1.0)).otherwise(value)

    return counted.select(*keys, *[ruled(scored[n]).alias(n) for n in ("precision", "recall", "f1")])


def macro_summary(scores: DataFrame) -> DataFrame:
    """Averages over queries."""
    return scores.agg(
        F.avg(F.col("accuracy").cast("double")).alias("accuracy"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        F.avg("f1").alias("f1"),
    )


def micro_summary(scores: DataFrame) -> DataFrame:
    """Ratios of the summed counts."""
    sums = scores.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
        F.avg(F.col("accuracy").cast("double")).alias("accuracy"),
    )
    scored = ratios(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select(*[scored[n].alias(n) for n in ("precision", "recall", "f1")], "accuracy")


def classification_report(pairs: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class, accuracy, macro and weighted averages, from one confusion table."""
    confusion = pairs.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("label").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0)
    sides = confusion.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
                F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
            )
        )
    )
    classes = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    scored = classes.select("class", precision.alias("precision"), recall.alias("recall"), "support", "tp").withColumn(
        "f1",
        F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0),
    )
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    summary = scored.agg(
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[(F.sum(F.col(n) * F.col("support")) / total).alias(f"weighted_{n}") for n in names],
        (F.sum("tp") / total).alias("accuracy"),
        total.alias("support"),
    )
    rows = summary.select(
        F.inline(
            F.array(
                F.struct(F.lit("macro avg").alias("class"), *[F.col(f"macro_{n}").alias(n) for n in names], "support"),
                F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"weighted_{n}").alias(n) for n in names], "support"),
                F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(n) for n in names], "support"),
            )
        )
    )
    return scored.select("class", *names, "support").unionByName(rows)
