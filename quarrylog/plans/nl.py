"""Natural-language scores over conversation pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.functions.text import sentences
from quarrylog.functions.vectors import cosine
from quarrylog.inputs import NL_PAIRS_SQL, embeddings, nl_pairs, table
from quarrylog.operators import nl_scores as ops
from quarrylog.registry import query

KEYS = ["conv_id", "turn"]
_PAIRS = o.with_(nl_pairs=NL_PAIRS_SQL)
_GRAM = {
    n: "list_transform(range(1, len({w}) - " + str(n - 2) + "), lambda i: " + " || ' ' || ".join(f"{{w}}[i + {j}]" for j in range(n)) + ")"
    for n in range(1, 5)
}


def _bleu_sql(words: str, keys: str, smooth: bool) -> str:
    """``words`` yields keys, r and g as word lists."""
    grams = " UNION ALL ".join(
        f"SELECT {keys}, {n} AS n, unnest({_GRAM[n].format(w=w)}) AS gram, {r} AS r, {g} AS g FROM w WHERE len({w}) >= {n}"
        for n in range(1, 5) for w, r, g in (("r", 1, 0), ("g", 0, 1))
    )
    hits = ", ".join(f"coalesce(sum(least(r, g)) FILTER (n = {n}), 0) AS h{n}, coalesce(sum(g) FILTER (n = {n}), 0) AS t{n}" for n in range(1, 5))
    logs = " + ".join(
        f"ln(greatest({f'CASE WHEN h{n} = 0 THEN 0.1 ELSE h{n} END' if smooth else f'h{n}'}, 1e-300) / greatest(t{n}, 1))" for n in range(1, 5)
    )
    none = "h1 = 0" if smooth else "least(h1, h2, h3, h4) = 0"
    return f"""w AS ({words}), a AS ({grams}),
 c AS (SELECT {keys}, n, gram, sum(r) AS r, sum(g) AS g FROM a GROUP BY ALL),
 s AS (SELECT {keys}, {hits}, coalesce(sum(r) FILTER (n = 1), 0) AS rl FROM c GROUP BY ALL),
 b AS (SELECT {keys}, CASE WHEN {none} THEN 0.0 ELSE
   (CASE WHEN t1 >= rl THEN 1.0 ELSE exp(1 - rl / greatest(t1, 1)) END) * exp(({logs}) / 4) END AS bleu FROM s)"""


_WORDS = r"SELECT conv_id, turn, regexp_extract_all(reference, '\S+') AS r, regexp_extract_all(generated, '\S+') AS g FROM nl_pairs"


@query("e17_bleu", _PAIRS + ", " + _bleu_sql(_WORDS, "conv_id, turn", False) + "SELECT conv_id, turn, round(bleu, 6) AS bleu FROM b")
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ops.bleu(nl_pairs(spark, sf_dir), KEYS, "reference", "generated")
    return scores.select(*KEYS, F.round("bleu", 6).alias("bleu"))


@query("e17_bleu_smoothed", _PAIRS + ", " + _bleu_sql(_WORDS, "conv_id, turn", True) + "SELECT conv_id, turn, round(bleu, 6) AS bleu FROM b")
def bleu_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ops.bleu(nl_pairs(spark, sf_dir), KEYS, "reference", "generated", smooth=True)
    return scores.select(*KEYS, F.round("bleu", 6).alias("bleu"))


_ROUGE = r"""t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(replace(reference, '.', ' '), '\S+')) AS r,
   list_distinct(regexp_extract_all(replace(generated, '.', ' '), '\S+')) AS g FROM nl_pairs),
 x AS (SELECT *, len(list_intersect(r, g)) / greatest(len(g), 1) AS p, len(list_intersect(r, g)) / greatest(len(r), 1) AS q FROM t)"""


@query("e19_rouge_1", _PAIRS + f", {_ROUGE} SELECT conv_id, turn, round(2 * p * q / (p + q + 1e-8), 6) AS rouge_1 FROM x")
def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = ops.rouge_1(F.col("reference"), F.col("generated"))
    return nl_pairs(spark, sf_dir).select(*KEYS, F.round(score, 6).alias("rouge_1"))


# The row of common lengths of a reference's prefixes, word by word of the generated text.
_NEXT_ROW = """list_reduce(list_prepend({'row': [0], 'j': CAST(0 AS BIGINT)}, list_transform(range(1, len(r) + 1), lambda j: {'row': CAST([] AS INTEGER[]), 'j': j})),
   lambda a, y: {'row': list_append(a.row, CASE WHEN r[y.j] = x.w THEN acc.row[y.j] + 1 ELSE greatest(acc.row[y.j + 1], a.row[y.j]) END), 'j': y.j}).row"""
_ROUGE_L = rf"""lw AS (SELECT conv_id, turn, regexp_extract_all(reference, '\S+') AS r, regexp_extract_all(generated, '\S+') AS g FROM nl_pairs),
 lc AS (SELECT *, list_reduce(list_prepend({{'row': list_transform(range(0, len(r) + 1), lambda j: 0), 'w': ''}}, list_transform(g, lambda w: {{'row': CAST([] AS INTEGER[]), 'w': w}})),
   lambda acc, x: {{'row': {_NEXT_ROW}, 'w': ''}}).row[-1] AS common FROM lw),
 rl AS (SELECT conv_id, turn, CASE WHEN len(r) + len(g) > 0 THEN 2 * common / (len(r) + len(g)) ELSE 0.0 END AS rouge_l FROM lc)"""


@query("e18_rouge_l", _PAIRS + f", {_ROUGE_L} SELECT conv_id, turn, round(rouge_l, 6) AS rouge_l FROM rl")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = ops.rouge_l(F.col("reference"), F.col("generated"))
    return nl_pairs(spark, sf_dir).select(*KEYS, F.round(score, 6).alias("rouge_l"))


_SENTENCES = r"list_filter(string_split(regexp_replace(trim({t}, ' ' || chr(10) || chr(9) || chr(13)), '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda s: s <> '')"


@query("f7_sentences", _PAIRS + f", s AS (SELECT conv_id, turn, {_SENTENCES.format(t='generated')} AS l FROM nl_pairs) SELECT conv_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM s")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nl_pairs(spark, sf_dir).select(*KEYS, F.posexplode(sentences(F.col("generated"))).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("e21_best_reference", _PAIRS + rf""", g AS (SELECT conv_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM (SELECT conv_id, turn, {_SENTENCES.format(t='generated')} AS l FROM nl_pairs) AS a),
 r AS (SELECT conv_id, turn, unnest(range(len(l))) AS rpos, unnest(l) AS ref FROM (SELECT conv_id, turn, {_SENTENCES.format(t='reference')} AS l FROM nl_pairs) AS b),
 w AS (SELECT *, list_distinct(regexp_extract_all(replace(sentence, '.', ' '), '\S+')) AS gw, list_distinct(regexp_extract_all(replace(ref, '.', ' '), '\S+')) AS rw FROM g JOIN r USING (conv_id, turn)),
 x AS (SELECT *, len(list_intersect(rw, gw)) / greatest(len(gw), 1) AS p, len(list_intersect(rw, gw)) / greatest(len(rw), 1) AS q FROM w),
 y AS (SELECT *, round(2 * p * q / (p + q + 1e-8), 9) AS score FROM x)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, sentence, ref AS best_reference, round(score, 6) AS score FROM y
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY score DESC, rpos) = 1""")
def best_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ops.best_reference(nl_pairs(spark, sf_dir), KEYS, "reference", "generated")
    return best.withColumn("score", F.round("score", 6))


_JOINED = r"""SELECT conv_id, regexp_extract_all(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), ''), '\S+') AS r,
  regexp_extract_all(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'user'), ''), '\S+') AS g FROM conversations GROUP BY conv_id"""


_JOINED_SETS = r""", z AS (SELECT conv_id, list_distinct(regexp_extract_all(replace(coalesce(string_agg(text, ' ') FILTER (role = 'user'), ''), '.', ' '), '\S+')) AS rs,
  list_distinct(regexp_extract_all(replace(coalesce(string_agg(text, ' ') FILTER (role <> 'user'), ''), '.', ' '), '\S+')) AS gs FROM conversations GROUP BY conv_id),
 k AS (SELECT conv_id, len(list_intersect(rs, gs)) / greatest(len(gs), 1) AS p, len(list_intersect(rs, gs)) / greatest(len(rs), 1) AS q FROM z)"""


@query("e22_joined_text", "WITH " + _bleu_sql(_JOINED, "conv_id", False) + _JOINED_SETS + """ SELECT conv_id, round(bleu, 6) AS bleu,
  round(2 * p * q / (p + q + 1e-8), 6) AS rouge_1 FROM b JOIN k USING (conv_id)""")
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("role") == "user", "ref").otherwise("gen")
    scores = ops.joined_text_scores(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], side, "text")
    return scores.select("conv_id", F.round("bleu", 6).alias("bleu"), F.round("rouge_1", 6).alias("rouge_1"))


_COSINES = """sem AS (SELECT a.vec_id AS conv_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
   / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS semantic
   FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


@query("a25_review_summary", _PAIRS + ", " + _bleu_sql(_WORDS, "conv_id, turn", False) + f", {_ROUGE_L}, {_COSINES}" + """
SELECT count(*) AS annotated, count(*) FILTER (len(reference) > len(generated)) AS adjusted,
  round_even(avg(bleu) * 100, 2) AS bleu, round_even(avg(rouge_l) * 100, 2) AS rouge, round_even(avg(coalesce(semantic, 0.0)) * 100, 2) AS semantic
  FROM nl_pairs JOIN b USING (conv_id, turn) JOIN rl USING (conv_id, turn) LEFT JOIN sem USING (conv_id)""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU, ROUGE-L and semantic score in percent.

    A pair whose reference is the longer text stands for an adjusted one. The
    vectors of a pair's texts are those of its conversation's number and the next
    one; a pair without vectors scores 0.
    """
    pairs = nl_pairs(spark, sf_dir)
    bleus = ops.bleu(pairs, KEYS, "reference", "generated")
    rouge = ops.rouge_l(F.col("reference"), F.col("generated"))
    own = embeddings(spark, sf_dir).select(F.col("vec_id").alias("conv_id"), "embedding")
    other = own.select((F.col("conv_id") - 1).alias("conv_id"), F.col("embedding").alias("other"))
    semantic = own.join(other, "conv_id").select("conv_id", cosine(F.col("embedding"), F.col("other")).alias("semantic"))
    adjusted = F.length("reference") > F.length("generated")
    scored = pairs.select(*KEYS, rouge.alias("rouge"), adjusted.alias("adjusted")).join(bleus, KEYS).join(semantic, "conv_id", "left")
    return scored.agg(
        F.count("*").alias("annotated"),
        F.count_if("adjusted").alias("adjusted"),
        F.bround(F.avg("bleu") * 100, 2).alias("bleu"),
        F.bround(F.avg("rouge") * 100, 2).alias("rouge"),
        F.bround(F.avg(F.coalesce("semantic", F.lit(0.0))) * 100, 2).alias("semantic"),
    )
