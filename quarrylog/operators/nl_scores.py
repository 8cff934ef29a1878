"""Scores of generated text against reference text."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylog.functions.sqltext import let
from quarrylog.functions.text import sentences, words
from quarrylog.operators.compute import once
from quarrylog.operators.sequence import ordered, with_previous

ORDERS = 4
SMOOTH = 0.1  # fixed value: stands for a zero count (published "method 1")
ROUGE_EPSILON = 1e-8  # fixed value: keeps the published ROUGE-1 F1 defined at zero


def bleu_value(hits: list[Column], totals: list[Column], ref_len: Column, gen_len: Column, smooth: bool) -> Column:
    """Geometric mean of the clipped precisions times the brevity penalty."""

    def log_precision(hit: Column, total: Column) -> Column:
        count = F.when(hit == 0, F.lit(SMOOTH)).otherwise(hit) if smooth else hit
        return F.log(F.greatest(count, F.lit(1e-300)) / F.greatest(total, F.lit(1)))

    mean_log = sum((log_precision(h, t) for h, t in zip(hits, totals)), F.lit(0.0)) / ORDERS
    brevity = F.when(gen_len >= ref_len, F.lit(1.0)).otherwise(F.exp(1 - ref_len / F.greatest(gen_len, F.lit(1))))
    # Without a single shared word the score is 0 either way; unsmoothed, one empty order is enough.
    none = (hits[0] == 0) if smooth else F.least(*hits) == 0
    return F.when(none, F.lit(0.0)).otherwise(brevity * F.exp(mean_log))


def _summed(per_gram: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: clipped hits and totals of each order, and the reference length."""
    hit = F.least("_ref", "_gen")
    orders = range(1, ORDERS + 1)
    return per_gram.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_n") == n, hit).otherwise(0)).alias(f"hit{n}") for n in orders],
        *[F.sum(F.when(F.col("_n") == n, F.col("_gen")).otherwise(0)).alias(f"total{n}") for n in orders],
        F.sum(F.when(F.col("_n") == 1, F.col("_ref")).otherwise(0)).alias("ref_len"),
    )


def _bleu_columns(smooth: bool) -> Column:
    orders = range(1, ORDERS + 1)
    return bleu_value(
        [F.col(f"hit{n}") for n in orders],
        [F.col(f"total{n}") for n in orders],
        F.col("ref_len"),
        F.col("total1"),
        smooth,
    )


def _count_grams(counts: Counter, tokens: list[str]) -> None:
    """Adds all n-grams of one text; the order goes with the words."""
    for n in range(1, ORDERS + 1):
        counts.update(zip(*[tokens[i:] for i in range(n)]))


def _overlaps(ref: Counter, gen: Counter) -> list[int]:
    """Clipped hits, then totals, of each order, and the reference length."""
    hits, totals = [0] * ORDERS, [0] * ORDERS
    for gram, count in gen.items():
        totals[len(gram) - 1] += count
        if both := ref.get(gram):
            hits[len(gram) - 1] += min(both, count)
    return [*hits, *totals, sum(count for gram, count in ref.items() if len(gram) == 1)]


SLICE = 64  # pairs whose words are Python lists at the same time


def bleu(pairs: DataFrame, keys: list[str], reference: str, generated: str, smooth: bool = False) -> DataFrame:
    """Sentence BLEU of each pair; ``keys`` identify a pair, pairs of equal keys count together.

    Whole texts are shuffled once by pair and sorted there; the n-grams are
    made and counted one key at a time and never become rows.
    """
    texts = pairs.select(*keys, F.col(reference).alias("_r"), F.col(generated).alias("_g"))
    texts = texts.repartition(*keys).sortWithinPartitions(*keys)
    names = [*[f"hit{n}" for n in range(1, ORDERS + 1)], *[f"total{n}" for n in range(1, ORDERS + 1)], "ref_len"]
    schema = T.StructType([texts.schema[k] for k in keys] + [T.StructField(n, T.LongType()) for n in names])
    arrow = to_arrow_schema(schema)

    def run(batches):
        held, ref, gen = None, Counter(), Counter()
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, SLICE):
                for *key, r, g in zip(*[c.to_pylist() for c in batch.slice(start, SLICE).columns], strict=True):
                    if held is not None and key != held:
                        out.append([*held, *_overlaps(ref, gen)])
                        ref, gen = Counter(), Counter()
                    held = key
                    _count_grams(ref, r or [])
                    _count_grams(gen, g or [])
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row, strict=True)) for row in out], schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, [*held, *_overlaps(ref, gen)], strict=True))], schema=arrow)

    worded = texts.select(*keys, words(F.col("_r")).alias("_r"), words(F.col("_g")).alias("_g"))
    return worded.mapInArrow(run, schema).select(*keys, _bleu_columns(smooth).alias("bleu"))


def rouge_words(text: Column) -> Column:
    """Distinct words; sentence dots part words and count for nothing."""
    return F.array_distinct(words(F.replace(text, F.lit("."), F.lit(" "))))


def set_f1(ref: Column, gen: Column) -> Column:
    shared = F.size(F.array_intersect(ref, gen))
    precision = shared / F.greatest(F.size(gen), F.lit(1))
    recall = shared / F.greatest(F.size(ref), F.lit(1))
    return 2 * precision * recall / (precision + recall + ROUGE_EPSILON)


def rouge_1(reference: Column, generated: Column) -> Column:
    """F1 of distinct words. Not clipped: words are sets."""
    return let(
        F.struct(rouge_words(reference).alias("r"), rouge_words(generated).alias("g")), lambda w: set_f1(w["r"], w["g"])
    )


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit rows: one whole-number step per word of ``b``."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        match = row & places.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """X3."""
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def rouge_l(reference: Column, generated: Column) -> Column:
    """F1 from the longest common subsequence of words."""
    ref, gen = words(reference), words(generated)
    common = lcs_words(ref, gen)
    total = F.size(ref) + F.size(gen)
    return F.when(total > 0, 2 * common / F.greatest(total, F.lit(1))).otherwise(0.0)


def best_reference(pairs: DataFrame, keys: list[str], reference: str, generated: str) -> DataFrame:
    """For each generated sentence the reference sentence with the best ROUGE-1, first one on ties.

    Sentences of one pair meet inside its row; only the best is kept.
    """

    def worded(text: Column) -> Column:
        return F.transform(sentences(text), lambda s: F.struct(s.alias("s"), rouge_words(s).alias("w")))

    split = once(pairs.select(*keys, reference, generated), refs=worded(F.col(reference))).select(
        *keys, "refs", F.posexplode(worded(F.col(generated))).alias("pos", "own")
    )
    scored = F.transform(
        "refs",
        lambda ref, i: F.struct(F.round(set_f1(ref["w"], F.col("own.w")), 9).alias("score"), (-i).alias("order")),
    )
    best = split.select(*keys, "pos", F.col("own.s").alias("sentence"), "refs", F.array_max(scored).alias("best"))
    return best.select(
        *keys, "pos", "sentence", F.col("refs")[-F.col("best.order")]["s"].alias("best_reference"), "best.score"
    )


def joined_text_scores(turns: DataFrame, group: str, order: list[str], side: Column, text: str) -> DataFrame:
    """BLEU and ROUGE-1 of all reference texts joined against all generated texts joined, per group.

    ``side`` is ``ref`` or ``gen``. The joined text is never built. N-grams
    that reach back over the start of a text need at most three words, which
    the three texts before it hold (texts without words are left out). Grams
    are counted by (group, gram), so a long group spans many tasks.
    """
    reach = ORDERS - 1
    worded = once(turns.select(group, side.alias("side"), *order, text), words=words(F.col(text))).drop(text)
    tail = F.slice("words", F.greatest(F.size("words") - (reach - 1), F.lit(1)), reach)
    seq = ordered(worded.where(F.size("words") > 0).withColumn("tail", tail), [group, "side", *order])
    seq = with_previous(seq, ["tail"], [group, "side"], depth=reach)
    none = F.array().cast("array<string>")
    before = F.concat(*[F.coalesce(c, none) for c in ("prev_3_tail", "prev_2_tail", "prev_tail")])
    carried = F.slice(before, F.greatest(F.size(before) - (reach - 1), F.lit(1)), reach)
    rows = once(seq.select(group, "side", "words", carried.alias("carried")), all=F.concat("carried", "words"))

    def ending_here(n: int) -> Column:
        # Grams whose last word is this text's own.
        first = F.greatest(F.size("carried") - (n - 2), F.lit(1))
        return F.transform(
            F.when(F.size("all") - n + 1 >= first, F.sequence(first, F.size("all") - n + 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.lit(n).alias("_n"), F.array_join(F.slice("all", i, F.lit(n)), " ").alias("_gram")),
        )

    counted = (
        rows.select(group, "side", F.inline(F.concat(*[ending_here(n) for n in range(1, ORDERS + 1)])))
        .groupBy(group, "_n", "_gram")
        .agg(F.count_if(F.col("side") == "ref").alias("_ref"), F.count_if(F.col("side") == "gen").alias("_gen"))
    )
    # Sentence dots part words for ROUGE, so its words are counted apart from the grams.
    loose = F.explode(F.flatten(F.transform("words", lambda w: words(F.replace(w, F.lit("."), F.lit(" "))))))
    seen = rows.select(group, "side", loose.alias("_word")).groupBy(group, "_word").agg(
        F.bool_or(F.col("side") == "ref").alias("_ref"), F.bool_or(F.col("side") == "gen").alias("_gen")
    )
    overlap = seen.groupBy(group).agg(
        F.count_if(F.col("_ref") & F.col("_gen")).alias("shared"),
        F.count_if("_ref").alias("ref_words"),
        F.count_if("_gen").alias("gen_words"),
    )
    precision = F.col("shared") / F.greatest(F.col("gen_words"), F.lit(1))
    recall = F.col("shared") / F.greatest(F.col("ref_words"), F.lit(1))
    scores = _summed(counted, [group]).select(group, _bleu_columns(False).alias("bleu"))
    rouge = overlap.select(group, (2 * precision * recall / (precision + recall + ROUGE_EPSILON)).alias("rouge_1"))
    return scores.join(rouge, group, "left").na.fill(0.0, ["rouge_1"])
