"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts are summed per cell (one value of every dimension). Raking scales
the cells until their sums over each dimension meet that dimension's target
shares. A cell's ratio of fitted to present tokens, scaled so that the expected
tokens of the result are a given share of those present, is its ``weight``. Above
1 it calls for ``copies``: a document is taken as often as the whole part says, and
once more with a chance of the rest. ``probability`` and ``kept`` are the draw without
copies: ratios scaled to a share of their own, cut at 1, and the others raised
until the share is met. So a tiny category is lifted and the others stay. The
draw is a hash of the id, so a task that runs again draws the same.

Defined cases: a null in a dimension is a category of its own (``NONE``). A
document without words weighs nothing and shares its cell's weight; a cell
without any words gets weight and probability 1. Repeated rows of an id share one draw. A
null id draws as the empty string. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.operators.joins import spread_join
from quarrylog.session import cut_lineage

NONE = "(none)"
DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 8
TOPICS = 6
#: Share of the tokens that are kept where no copies are made.
KEPT_SHARE = 0.6


def topic_of(words: Column, topics: int = TOPICS) -> Column:
    """Stand-in topic where no topic column is given: bucket of the longest word's first letter (ties: the greatest word)."""
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return F.coalesce(F.concat(F.lit("t"), (F.ascii(longest) % topics).cast("string")), F.lit(NONE))


def smoothed_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares ``(value, share)``: present shares to ``power``, which lifts small categories."""
    sums = cut_lineage(cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("raised")))
    total = sums.agg(F.sum("raised")).first()[0] or 1.0
    return sums.select("value", (F.col("raised") / total).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``fitted`` tokens after ``rounds`` passes over all dimensions.

    A step reads and writes the cell table only (its size is that of the
    categories, not of the corpus); each is cut, since the next one reads it twice.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    fitted = cells.withColumn("fitted", F.col("tokens").cast("double"))
    goals = {d: cut_lineage(t.select(F.col("value").alias(d), F.col("share").alias("goal"))) for d, t in targets.items()}
    for _ in range(rounds):
        for d, goal in goals.items():
            now = fitted.groupBy(d).agg(F.sum("fitted").alias("now")).join(goal, d)
            by = now.select(d, F.when(F.col("now") > 0, F.col("goal") * total / F.col("now")).otherwise(0.0).alias("by"))
            fitted = cut_lineage(fitted.join(by, d).select(*cells.columns, (F.col("fitted") * F.col("by")).alias("fitted")))
    return fitted


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / float(2**48)


def scale(ratios: DataFrame, share: float, repeats: bool) -> float:
    """What turns the ratios (``tokens, fitted, ratio``) into weights with ``share`` of all tokens.

    Without repeats a weight counts as 1 at most. Each pass reads the cells and
    raises the scale for what the cells found at 1 leave open; their number only
    grows, and the scale is right when it stays.
    """
    sums = ratios.agg(F.sum("tokens"), F.sum("fitted")).first()
    budget, by = share * (sums[0] or 0), 1.0
    if sums[1]:
        by = budget / sums[1]
    before = 0
    while not repeats:
        whole = F.col("ratio") * by >= 1
        full, rest, n = ratios.where("ratio is not null").agg(F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("fitted"))), F.count_if(whole)).first()
        if n == before or not rest:
            break
        by, before = max(by, (budget - full) / rest), n
    return by


def mix(
    docs: DataFrame, id_col: str, tokens: str, dimensions: tuple[str, ...] = DIMENSIONS, targets: dict[str, DataFrame] | None = None,
    power: float = 0.7, rounds: int = ROUNDS, seed: int = 17, share: float = 1.0, kept_share: float = KEPT_SHARE,
) -> DataFrame:
    """One row per input row: id, tokens, dimensions, ``probability``, ``kept``, ``weight`` and ``copies``.

    ``targets`` maps dimensions to ``(value, share)`` frames; a dimension without
    one gets smoothed shares. Values that a target leaves out are not sampled.
    ``copies`` of all rows hold about ``share`` of the tokens, the ``kept`` rows about ``kept_share``.
    """
    packed = [F.coalesce(F.col(d).cast("string"), F.lit(NONE)).alias(d) for d in dimensions]
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens"), *packed))
    keys = list(dimensions)
    cells = cut_lineage(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")))
    goals = {d: (targets or {}).get(d) for d in dimensions}
    goals = {d: smoothed_targets(cells, d, power) if t is None else t for d, t in goals.items()}
    fitted = rake(cells, goals, rounds)
    ratio = fitted.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")))
    once, often = (F.col("ratio") * scale(ratio, s, repeats) for s, repeats in ((kept_share, False), (share, True)))
    chances = ratio.select(*keys, "n_docs", F.coalesce(F.least(once, F.lit(1.0)), F.lit(1.0)).alias("probability"), F.coalesce(often, F.lit(1.0)).alias("weight"))
    out = spread_join(rows, cut_lineage(chances), keys, ["id"], n="n_docs")
    drawn = uniform(F.col("id"), seed)
    copies = F.floor("weight") + (drawn < F.col("weight") - F.floor("weight")).cast("long")
    return out.select("id", "tokens", *keys, "probability", (drawn < F.col("probability")).alias("kept"), "weight", copies.alias("copies"))


def sample(docs: DataFrame, id_col: str, tokens: Column, topic: Column, source: str = "source", lang: str = "lang", seed: int = 17, share: float = KEPT_SHARE) -> DataFrame:
    """The rows of ``docs`` that a mix keeps, unchanged: about ``share`` of the tokens."""
    facts = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"), F.col(source).alias("source"), F.col(lang).alias("lang"), topic.alias("topic"))
    kept = mix(facts, "id", "tokens", seed=seed, kept_share=share)
    kept = kept.where("kept").select(F.col("id").alias("keep"), *[F.col(d).alias(f"keep_{d}") for d in DIMENSIONS]).distinct()
    here = [F.coalesce(F.col(source), F.lit(NONE)), F.coalesce(F.col(lang), F.lit(NONE)), F.coalesce(topic, F.lit(NONE))]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), *[c.cast("string").alias(d) for c, d in zip(here, DIMENSIONS, strict=True)])
    same = F.col("id").eqNullSafe(F.col("keep"))
    for d in DIMENSIONS:
        same = same & (F.col(d) == F.col(f"keep_{d}"))
    return rows.join(kept.hint("shuffle_hash"), same, "left_semi").select("row.*")
