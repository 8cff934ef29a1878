"""Column expressions over natural-language and mixed text."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quarrylog.functions.sqltext import let, strip


def words(text: Column) -> Column:
    """White-space tokens."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` before white space; the mark stays."""
    marked = F.regexp_replace(strip(text), r"([.!?])\s+", "$1\x02")
    return F.filter(F.split(marked, "\x02"), lambda s: s != "")


def ngrams(tokens: Column, n: int) -> Column:
    """F8: contiguous n-grams joined by one space; none when there are fewer tokens."""
    return let(
        tokens,
        lambda t: F.when(
            F.size(t) >= n,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))),
                lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def clean_marker(option: Column) -> Column:
    """a short first word that is no plain word is a list marker and goes."""
    parts = words(option)
    first = F.try_element_at(parts, F.lit(1))
    is_marker = (F.length(first) < 5) & ~first.rlike(r"^\p{L}+$")
    rest = F.array_join(F.slice(parts, 2, 1 << 30), " ")
    return F.when(is_marker, rest).otherwise(option)


def split_numbered(text: Column) -> Column:
    """options of a numbered answer; a colon anywhere selects ``1:`` marks over ``1.`` marks."""
    by_dot = F.split(text, r"[0-9]+\.\s")
    by_colon = F.split(text, r"[0-9]+:\s")
    chosen = F.when(text.contains(":"), by_colon).when(text.contains("."), by_dot).otherwise(F.array(text))
    return F.filter(chosen, lambda option: F.length(option) > 10)


def split_candidates(text: Column) -> Column:
    """SQL candidates between semicolons, blanks dropped."""
    return F.filter(F.transform(F.split(text, ";"), lambda part: strip(part)), lambda part: part != "")


def option_lines(text: Column) -> Column:
    """Answer lines that are options, their markers cleaned."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda line: strip(line))
    kept = F.filter(lines, lambda x: (x != "") & ~F.upper(x).contains("OPTION") & ~x.contains(":"))
    return F.transform(kept, clean_marker)


def long_options(options: Column) -> Column:
    """P12, combined path: options of more than three characters."""
    return F.filter(options, lambda x: F.length(x) > 3)


@F.pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """compatibility decomposition, then ASCII only."""
    return text.map(
        lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    )


def contraction_map() -> dict[str, str]:
    """Contractions by rule: subject + ending, verb + n't, and the fixed forms."""
    subjects = ["i", "you", "he", "she", "it", "we", "they", "that", "there", "who", "what", "how", "where"]
    endings = {"'d": "would", "'d've": "would have", "'ll": "will", "'ll've": "will have", "'ve": "have"}
    table = {f"{s}{e}": f"{s} {full}" for s in subjects for e, full in endings.items()}
    table |= {f"{s}'re": f"{s} are" for s in ("you", "we", "they", "what", "who")}
    table |= {f"{s}'s": f"{s} is" for s in ("he", "she", "it", "that", "there", "who", "what", "how", "where", "when", "why")}
    stems = "are could did does do had has have is might must need should was were would".split()
    table |= {f"{v}n't": f"{v} not" for v in stems}
    table |= {f"{v}n't've": f"{v} not have" for v in ("could", "might", "must", "need", "should", "would")}
    table |= {f"{v}'ve": f"{v} have" for v in ("could", "might", "must", "should", "would")}
    table |= {"i'm": "i am", "can't": "can not", "can't've": "can not have", "won't": "will not",
              "won't've": "will not have", "shan't": "shall not", "ain't": "is not", "let's": "let us",
              "y'all": "you all", "ma'am": "madam", "o'clock": "of the clock", "'cause": "because"}
    return table


@F.pandas_udf(T.StringType())
def _expanded(text: pd.Series) -> pd.Series:
    table = contraction_map()
    longest_first = sorted(table, key=lambda c: (-len(c), c))
    pattern = re.compile("|".join(re.escape(c) for c in longest_first), re.I)

    def full(match: re.Match) -> str:
        found = match.group(0)
        return found[0] + table[found.lower()][1:] if found[0] != "'" else table[found.lower()]

    def expanded(s: str) -> str:
        # A contraction holds an apostrophe and no space, so only such words are searched.
        return " ".join([pattern.sub(full, word) if "'" in word else word for word in s.split(" ")]) if "'" in s else s

    return text.map(lambda s: None if s is None else expanded(s))


def expand_contractions(text: Column) -> Column:
    """longest first, any case, the first character kept; then every ' goes."""
    return F.replace(_expanded(text), F.lit("'"), F.lit(""))


def drop_specials(text: Column, digits_too: bool = True) -> Column:
    """F16."""
    return F.regexp_replace(text, r"[^a-zA-Z\s]" if digits_too else r"[^a-zA-Z0-9\s]", "")


# English function words, with the stumps that contractions leave behind.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn
shan shouldn wasn weren won wouldn
""".split()


def drop_stop_words(text: Column) -> Column:
    """F17."""
    return F.array_join(F.filter(words(text), lambda w: ~F.lower(w).isin(*STOP_WORDS)), " ")


def normalise(text: Column, fold: bool = True) -> Column:
    """F18 in order: accents, contractions, lower case, line ends, specials, spaces, stop words."""
    text = fold_accents(text) if fold else text
    text = F.lower(expand_contractions(text))
    text = F.regexp_replace(text, r"[\r\n]+", " ")
    # Brackets, dots and exclamation marks part words before they are dropped.
    text = F.regexp_replace(text, r"([{.()!}])", " $1 ")
    text = F.trim(F.regexp_replace(drop_specials(text), " +", " "))
    return drop_stop_words(text)


def significant(x: Column, digits: int = 3) -> Column:
    """F19."""
    return F.when(x.isNull() | (x == 0), x.cast("double")).otherwise(F.format_string(f"%.{digits - 1}e", x.cast("double")).cast("double"))


def short_value(text: Column, width: int = 25) -> Column:
    """F20, strings."""
    return F.substring(text, 1, width)


def short_number(x: Column, digits: int = 3) -> Column:
    """F20, numbers: ``digits`` significant ones without closing zeros; an exponent below 1e-4 and from ``10 ** digits`` on.

    Halves go to the even digit. NaN and infinities give null.
    """
    # The text is named again and again below: formatted once per number.
    exponent = F.substring_index(F.format_string(f"%.{digits - 1}e", x.cast("double")), "e", -1)
    return let(
        F.struct(x.cast("double").alias("x"), exponent.alias("exponent")),
        lambda n: let(n["exponent"].try_cast("int"), lambda power: _shown(n["x"], n["exponent"], power, digits)),
    )


def _shown(x: Column, exponent: Column, power: Column, digits: int) -> Column:
    shift = power - (digits - 1)
    scaled = F.when(shift >= 0, x / F.pow(F.lit(10.0), shift)).otherwise(x * F.pow(F.lit(10.0), -shift))
    return let(F.abs(F.rint(scaled)).cast("long").cast("string"), lambda shown: _placed(x, exponent, power, shown, digits))


def _placed(x: Column, exponent: Column, power: Column, shown: Column, digits: int) -> Column:
    bare = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    parted = lambda n: F.concat(F.substring(shown, 1, n), F.lit("."), F.substring(shown, n + 1, digits))
    plain = F.when(power == digits - 1, shown)
    for p in range(digits - 1):
        plain = plain.when(power == p, bare(parted(p + 1)))
    for p in range(-4, 0):
        plain = plain.when(power == p, bare(F.concat(F.lit("0." + "0" * (-p - 1)), shown)))
    with_power = F.concat(bare(parted(1)), F.lit("e"), exponent)
    unsigned = F.when((power < -4) | (power >= digits), with_power).otherwise(plain)
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), unsigned))
