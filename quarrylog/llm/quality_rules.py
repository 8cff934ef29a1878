"""Line-first document cleaning with DataFrame functions only.

Every line is judged by its own rules (punctuation, navigation, boilerplate);
lines that fail are taken out, and a document that loses too much of its words
is rejected. Document-wide figures (words, symbols, repeated lines and word
windows) reject a document before that.

Defined cases: a null or empty text has no words and is rejected as too short.
Blank lines are neither judged nor counted. Repeated rows are judged row by row.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.operators.compute import once

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are of words, or of characters for symbols and capitals."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_line_symbol_share: float = 0.1
    max_line_shout_share: float = 0.5
    max_menu_separators: int = 3
    min_open_line_words: int = 4
    min_kept_percent: int = 50
    navigation: str = r"(?i)^\W*(home|menu|login|log in|sign in|sign up|next|previous|back to top|read more|share|search|skip to content)\W*$"
    boilerplate: str = r"(?i)lorem ipsum|enable javascript|uses cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved|subscribe to our"


DEFAULT = Rules()


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _longer(hashes: Column, gap: int) -> Column:
    """Hashes of each entry with the one ``gap`` later."""

    def joined(h: Column) -> Column:
        return F.zip_with(h, F.slice(h, gap + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    # transform over a one-element array binds a value that is used twice
    return F.get(F.transform(F.array(hashes), joined), F.lit(0))


def _window_hashes(words: Column, n: int) -> Column:
    """One hash per window of ``n`` words; there are at least ``n``."""
    found, length = F.transform(words, lambda w: F.xxhash64(w)), 1
    while length < n:
        gap = min(length, n - length)  # the last two halves overlap unless n is a power of two
        found, length = _longer(found, gap), length + gap
    return F.slice(found, 1, F.size(words) - n + 1)


def repeated_window_words(words: Column, n: int = WINDOW) -> Column:
    """How many words stand in an ``n``-word window that the text holds twice or more.

    ``words`` must be a plain column. A word is hashed once; window hashes grow
    by doubling, so a window costs a few hashes of two numbers. Equal windows
    are neighbours once the (window hash, position) pairs are sorted, so the
    cost is that of a sort.
    """
    hashes = F.when(F.size(words) >= n, _window_hashes(words, n)).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        """Union length of windows that begin at the sorted ``starts``."""
        steps = F.transform(starts, lambda p, k: F.least(F.get(starts, k + 1) - p, F.lit(n)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def starts_of(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda e, k: (e["h"] == F.get(pairs, k - 1)["h"]) | (e["h"] == F.get(pairs, k + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda e: e["at"]))

    # transform over a one-element array binds a value that the inner lambdas use many times
    def counted(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        whole = F.transform(F.array(pairs), lambda p: F.get(F.transform(F.array(starts_of(p)), covered), F.lit(0)))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(F.get(whole, F.lit(0)))

    return F.get(F.transform(F.array(hashes), counted), F.lit(0))


def has_words(line: Column, n: int) -> Column:
    """Whether a line has ``n`` words or more; reads no further than the last of them."""
    return line.rlike(rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{n - 1}}}[^\x20\x09-\x0D]")


def line_passes(line: Column, is_open: Column, rules: Rules) -> Column:
    """The three line rules; ``is_open`` tells whether the line has ``min_open_line_words`` words or more."""
    symbols = F.size(F.split(line, SYMBOLS, -1)) - 1
    capitals = F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}+", ""))
    letters = F.length(line) - F.length(F.regexp_replace(line, r"\p{L}+", ""))
    shouting = is_open & (capitals > letters * rules.max_line_shout_share)
    ends = line.rlike(r"[.!?:;…。\"'”’)\]][\x20\x09-\x0D]*$")
    punctuation = (symbols <= F.length(line) * rules.max_line_symbol_share) & ~shouting & (is_open | ends)
    rare = F.when(line.contains("»") | line.contains("›") | line.contains("•"), F.size(F.split(line, "[»›•]", -1)) - 1).otherwise(0)
    separators = F.size(F.split(line, r"\|", -1)) - 1 + rare
    navigation = (separators >= rules.max_menu_separators) | line.rlike(rules.navigation)
    return punctuation & ~navigation & ~line.rlike(rules.boilerplate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = DEFAULT) -> DataFrame:
    """One row per input row: figures, verdict and ``cleaned`` (the text without failed lines)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    rows = once(
        rows,
        _words=words_of(text),
        _lines=F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")),
        n_symbols=(F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long"),
    )

    def judged(line: Column) -> Column:
        counted = F.transform(F.array(F.size(words_of(line))), lambda n: F.struct(line.alias("line"), n.alias("n"), line_passes(line, n >= rules.min_open_line_words, rules).alias("ok")))
        return F.get(counted, F.lit(0))

    figures = once(
        rows,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.array_join("_words", "")).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_repeat_words=repeated_window_words(F.col("_words")).cast("long"),
        _judged=F.transform("_lines", judged),
    )
    good = F.filter("_judged", lambda x: x["ok"])
    few, repeats = F.col("n_words") < rules.min_words, 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    out = figures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (few | repeats).alias("base_failed"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(good)).cast("long").alias("n_failed_lines"),
        F.aggregate(good, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_kept_words"),
        F.concat_ws("\n", F.transform(good, lambda x: x["line"])).alias("cleaned"),
    )
    enough = 100 * F.col("n_kept_words") >= rules.min_kept_percent * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & enough)


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged; each row is judged where it lies, with no shuffle."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_body"))
    verdict = judge(packed, "_row", "_body", rules)
    return verdict.where("kept").select("doc_id.*")
