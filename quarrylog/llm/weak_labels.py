"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of vote patterns (at most three to the
number of labellers, whatever the corpus) estimates each labeller's accuracy and
the share of good documents. The posterior labels of a bounded, hashed sample
(``Config.train_rows``) train a linear scorer over hashed words and word shapes,
which scores every document.

Defined cases: a null or empty text has no votes and scores by the posterior of
that, the share of good documents. If the sample holds one class only, every
score is that class. Repeated rows give repeated rows, an empty table an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.llm.quality_rules import DEFAULT as RULES, SYMBOLS, has_words, line_passes, words_of
from quarrylog.operators.compute import once
from quarrylog.session import cut_lineage

GOOD, BAD, NOTHING = 1, 0, 2
LABELLERS = ("symbols", "separators", "capitals", "repeats", "variety", "endings", "word_length", "doubled_marks", "failed_lines")


#: A whole word of two characters or more with capitals and without small letters; its first character is looked at first.
CAPITAL_WORD = r"(?=[^\x20\x09-\x0D\p{Ll}])(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]{2})[^\x20\x09-\x0D\p{Ll}\p{Lu}]*+\p{Lu}[^\x20\x09-\x0D\p{Ll}]*+(?![^\x20\x09-\x0D])"

#: What is believed of a labeller before any vote, per class (bad, good) and vote (bad, good, nothing): votes against
#: are rare on good documents. It weighs this share of all documents.
PRIOR = np.array([[0.3, 0.5, 0.2], [0.002, 0.898, 0.1]])
PRIOR_WEIGHT = 0.2


@dataclass(frozen=True)
class Config:
    train_rows: int = 20_000
    buckets: int = 1 << 15
    rounds: int = 50
    seed: int = 11
    min_score: float = 0.5
    regularisation: float = 1e-4


DEFAULT = Config()


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NOTHING)


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, words, text``, ``n_repeats`` (words like the one before) and one vote column per labeller."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = once(rows, words=words_of(F.col("text")))
    n = F.greatest(F.size("words"), F.lit(1)).cast("double")
    characters = F.greatest(F.length("text"), F.lit(1)).cast("double")
    pieces = lambda pattern: F.size(F.split("text", pattern, -1)) - 1

    def failed_words(line: Column) -> Column:
        # Most lines pass, and their words need no count.
        return F.when(line_passes(line, has_words(line, RULES.min_open_line_words), RULES), 0).otherwise(F.size(words_of(line)))

    rows = once(
        rows,
        symbols=pieces(SYMBOLS) / characters,
        separators=pieces(r"\|") / n,
        capitals=F.regexp_count("text", F.lit(CAPITAL_WORD)) / n,
        n_repeats=F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))),
        variety=F.size(F.array_distinct("words")) / n,
        endings=pieces(r"[.!?](?=[\x20\x09-\x0D]|$)") / n,
        word_length=F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)) / n,
        doubled=pieces(r"([!?#*$%&])\1") / n,
        failed=F.aggregate(F.transform(F.split("text", "\n", -1), failed_words), F.lit(0), lambda a, x: a + x) / n,
    )
    rows = rows.withColumn("repeats", F.col("n_repeats") / n)
    some = F.size("words") > 0
    between = lambda name, bad, good: _vote(some & (F.col(name) > bad), some & (F.col(name) < good))
    return rows.select(
        "doc_id", "words", "text", "n_repeats",
        between("symbols", 0.03, 0.003).alias("symbols"),
        between("separators", 0.1, 0.01).alias("separators"),
        between("capitals", 0.3, 0.05).alias("capitals"),
        between("repeats", 0.1, 0.03).alias("repeats"),
        _vote((F.size("words") >= 50) & (F.col("variety") < 0.2 * F.least(F.lit(1.0), 500 / n)), some & (F.col("variety") > 0.4)).alias("variety"),
        _vote((F.size("words") >= 40) & (F.col("endings") < 0.01), some & (F.col("endings") > 0.02)).alias("endings"),
        _vote(some & (F.col("word_length") > 15), F.lit(False)).alias("word_length"),
        between("doubled", 0.1, 0.01).alias("doubled_marks"),
        between("failed", 0.5, 0.1).alias("failed_lines"),
    )


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray]:
    """EM for the share of good documents and ``P(vote | class)`` (labeller, class, vote), from distinct patterns."""
    chosen = (patterns[:, :, None] == np.arange(3)).astype(float)  # pattern, labeller, vote
    good = 1 / (1 + np.exp(4.0 * (patterns == BAD).sum(1) - 2.0))  # to begin with, any vote against counts
    for _ in range(rounds):
        weights = np.stack([counts * (1 - good), counts * good])  # class, pattern
        table = np.einsum("cp,plv->lcv", weights, chosen) + PRIOR * PRIOR_WEIGHT * counts.sum() + 0.1
        table /= table.sum(2, keepdims=True)
        prior = (weights.sum(1) + 1) / (counts.sum() + 2)
        logs = np.einsum("plv,lcv->pc", chosen, np.log(table)) + np.log(prior)
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return float(prior[1]), table


def posterior(prior: float, table: np.ndarray, names: tuple[str, ...] = LABELLERS) -> Column:
    """P(good | votes) from the fitted tables, as an expression over the vote columns."""
    logit = F.lit(float(np.log(prior) - np.log1p(-prior)))
    for name, by_class in zip(names, table, strict=True):
        odds = F.array(*[F.lit(float(x)) for x in np.log(by_class[1]) - np.log(by_class[0])])
        logit = logit + F.get(odds, F.col(name))
    return 1 / (1 + F.exp(-logit))


def features(voted: DataFrame) -> DataFrame:
    """``parts``: words in lower case, word shapes (runs of capitals, small letters and digits as one mark each) and repeats."""
    shape = F.col("text")
    for pattern, mark in ((r"\p{Lu}+", "\x01"), (r"\p{Ll}+", "\x02"), (r"\p{N}+", "\x03")):
        shape = F.regexp_replace(shape, pattern, mark)
    parts = F.concat(words_of(F.lower("text")), words_of(shape), F.array_repeat(F.lit("\x04"), F.col("n_repeats")))
    return voted.withColumn("parts", parts).drop("n_repeats", "text")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Config = DEFAULT) -> DataFrame:
    """``doc_id, posterior, score, kept`` of every row, and the votes."""
    voted = cut_lineage(votes(docs, id_col, text_col).drop("words"))  # judged once, read for the patterns, the sample and the scores
    seen = voted.groupBy(*LABELLERS).count().collect()  # bounded: 3 ** len(LABELLERS) patterns at most
    if not seen:
        return voted.select("doc_id", *LABELLERS, F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    patterns, counts = np.array([row[:-1] for row in seen]), np.array([row[-1] for row in seen], float)
    prior, table = fit_votes(patterns, counts, config.rounds)
    known = features(voted).withColumn("posterior", posterior(prior, table))

    rate = min(1.0, config.train_rows / counts.sum())
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(config.seed)), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1
    sides = F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))
    sample = known.where(drawn).select("parts", F.explode(sides).alias("side")).select("parts", "side.*").where("weight > 0.001")
    sample = cut_lineage(sample)  # the fit reads it more than once
    hashed = [HashingTF(inputCol="parts", outputCol="counts", numFeatures=config.buckets), Normalizer(inputCol="counts", outputCol="features")]
    linear = LogisticRegression(weightCol="weight", regParam=config.regularisation, maxIter=40, probabilityCol="chance")
    model = Pipeline(stages=[*hashed, linear]).fit(sample)
    scored = model.transform(known)
    score = F.when(F.size("parts") == 0, F.col("posterior")).otherwise(vector_to_array("chance")[1])
    return scored.select("doc_id", *LABELLERS, "posterior", score.alias("score")).withColumn("kept", F.col("score") >= config.min_score)
