"""Similarity search over the embedding table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.functions.scores import ratios
from quarrylog.functions.vectors import cosine
from quarrylog.inputs import embeddings
from quarrylog.operators import similarity as ops
from quarrylog.operators.joins import spread_join
from quarrylog.registry import query

_MEANS = """cells AS (SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
 m AS (SELECT label, i, avg(x) AS x FROM cells GROUP BY ALL),
 means AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label)"""
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_PAIRS = f"""s AS (SELECT a.vec_id AS q_id, b.vec_id AS t_id, a.label AS gold, b.label AS label,
  round({_COS.format(a='a.embedding', b='b.embedding')}, 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, t_id) AS INTEGER) AS rank FROM s)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mean_vectors(embeddings(spark, sf_dir), "label", "embedding")


@query("t1_top10_similar", f"WITH {_PAIRS} SELECT q_id, t_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def top10_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 10 of every vector among all others."""
    both = vectors(spark, sf_dir)
    best = ops.top_similar(both, both, 10, skip_same_id=True)
    return best.select("q_id", "t_id", "rank", F.round("score", 6).alias("score"))


@query("v1_cosine", f"WITH {_MEANS} SELECT vec_id, round({_COS.format(a='embedding', b='v')}, 6) AS score FROM embeddings JOIN means USING (label)")
def cosine_to_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = spread_join(embeddings(spark, sf_dir), label_means(spark, sf_dir), ["label"], ["vec_id"])
    return joined.select("vec_id", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))


@query("e20_cosine_score", f"""SELECT a.vec_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine_score
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector and the next one stand for the two texts of a pair."""
    own = embeddings(spark, sf_dir).select("vec_id", "embedding")
    other = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return own.join(other, "vec_id").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine_score")
    )


@query("v2_mean_pooling", f"WITH {_MEANS} SELECT label, i - 1 AS i, round(x, 6) AS x FROM m")
def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = label_means(spark, sf_dir).select("label", F.posexplode("vector").alias("i", "x"))
    return flat.select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("t2_full_rank", f"""WITH cells AS (SELECT unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
 probe AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(x) AS x FROM cells GROUP BY i) AS m)
SELECT vec_id AS id, round({_COS.format(a='embedding', b='v')}, 6) AS score FROM embeddings, probe""")
def full_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors ranked against the mean vector."""
    probe = ops.mean_vectors(embeddings(spark, sf_dir).withColumn("all", F.lit(0)), "all", "embedding")
    return ops.rank_all(vectors(spark, sf_dir), probe).select("id", F.round("score", 6).alias("score"))


@query("t4_suggestion_slots", f"""WITH {_PAIRS} SELECT q_id, t_id, rank, CASE WHEN rank <= 5 THEN 'suggested' ELSE 'extra' END AS slot
  FROM r WHERE rank <= 10""")
def suggestion_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = vectors(spark, sf_dir)
    ranked = ops.top_similar(both, both, 10, skip_same_id=True)
    return ops.slice_suggestions(ranked, 5, 5).select("q_id", "t_id", "rank", "slot")


@query("t5_sub_query_slots", f"""WITH {_PAIRS}
SELECT q_id, t_id, CASE WHEN rank <= 2 THEN 'suggested' ELSE 'extra' END AS slot FROM r WHERE rank <= 5""")
def sub_query_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = vectors(spark, sf_dir)
    ranked = ops.top_similar(both, both, 5, skip_same_id=True)
    return ops.slice_suggestions(ranked, 2, 3).select("q_id", "t_id", "slot")


@query("t4_table_suggestions", f"""WITH {_MEANS}, s AS (SELECT vec_id AS q_id, e.label AS gold, m.label AS table_name,
   round({_COS.format(a='embedding', b='v')}, 9) AS score FROM embeddings e, means m),
 x AS (SELECT q_id, table_name, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, table_name) AS INTEGER) AS rank FROM s WHERE table_name <> gold)
SELECT q_id, table_name, rank, 'extra' AS slot FROM x WHERE rank <= 5
UNION ALL SELECT vec_id, label, 1, 'suggested' FROM embeddings""")
def table_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for tables: a vector's own label is its gold table, the label means are ranked."""
    tables = label_means(spark, sf_dir).select(F.col("label").alias("id"), "vector")
    # One more than asked for, since the gold table drops out.
    ranked = ops.top_similar(vectors(spark, sf_dir), tables, 6).select("q_id", "rank", F.col("t_id").alias("table_name"))
    gold = embeddings(spark, sf_dir).select(F.col("vec_id").alias("q_id"), F.lit(1).alias("pos"), F.col("label").alias("table_name"))
    return ops.suggest_tables(gold, ranked, 5)


_KNOWN = "SELECT label AS table_name FROM embeddings GROUP BY label HAVING count(*) >= (SELECT count(*) / count(DISTINCT label) FROM embeddings)"


@query("t5_table_suggestions", f"""WITH {_MEANS}, known AS ({_KNOWN}), s AS (SELECT vec_id AS q_id, e.label AS gold, m.label AS table_name,
   round({_COS.format(a='embedding', b='v')}, 9) AS score FROM embeddings e, means m),
 x AS (SELECT q_id, table_name, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, table_name) AS INTEGER) AS rank FROM s WHERE table_name <> gold)
SELECT q_id, table_name, rank, 'extra' AS slot FROM x WHERE rank <= 2
UNION ALL SELECT vec_id, label, 1, 'suggested' FROM embeddings WHERE label IN (SELECT table_name FROM known)""")
def known_table_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extra tables; gold tables are shown if known, here the labels with at least the mean number of vectors."""
    counts = embeddings(spark, sf_dir).groupBy(F.col("label").alias("table_name")).agg(F.count("*").alias("n"))
    known = counts.where(F.col("n") >= counts.agg(F.avg("n")).scalar())
    tables = label_means(spark, sf_dir).select(F.col("label").alias("id"), "vector")
    ranked = ops.top_similar(vectors(spark, sf_dir), tables, 3).select("q_id", "rank", F.col("t_id").alias("table_name"))
    gold = embeddings(spark, sf_dir).select(F.col("vec_id").alias("q_id"), F.lit(1).alias("pos"), F.col("label").alias("table_name"))
    return ops.suggest_tables(gold, ranked, 2, known)


@query("j13_best_match", f"""WITH {_MEANS}, s AS (SELECT vec_id, m.label, round({_COS.format(a='embedding', b='v')}, 9) AS score FROM embeddings e, means m)
SELECT vec_id AS q_id, label AS t_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = label_means(spark, sf_dir).select(F.col("label").alias("id"), "vector")
    best = ops.top_similar(vectors(spark, sf_dir), references, 1)
    return best.select("q_id", "t_id", F.round("score", 6).alias("score"))


_AT_K = f"""WITH {_PAIRS}, p AS (SELECT q_id, any_value(gold) AS gold, count(DISTINCT label) AS n, bool_or(label = gold) AS hit FROM r WHERE rank <= 5 GROUP BY q_id),
 x AS (SELECT q_id, CASE WHEN hit THEN 1.0 / n ELSE 0 END AS precision, CAST(CASE WHEN hit THEN 1.0 ELSE 0.0 END AS DOUBLE) AS recall FROM p)"""


def _at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the five nearest vectors as retrieved tables, the own label as the gold one."""
    both = vectors(spark, sf_dir)
    labels = embeddings(spark, sf_dir).select("vec_id", "label")
    near = ops.top_similar(both, both, 5, skip_same_id=True).select("q_id", F.col("t_id").alias("vec_id"))
    found = near.join(labels, "vec_id").groupBy("q_id").agg(F.collect_set("label").alias("pred"))
    gold = labels.select(F.col("vec_id").alias("q_id"), F.col("label").alias("gold"))
    sets = found.join(gold, "q_id")
    hit = F.array_contains("pred", F.col("gold")).cast("long")
    scored = ratios(hit, F.size("pred") - hit, 1 - hit, empty_precision=0.0)
    return sets.select("q_id", *[scored[n].alias(n) for n in ("precision", "recall", "f1")])


@query("e24_retrieval_at_k", _AT_K + """SELECT round(avg(precision) * 100, 1) AS precision, round(avg(recall) * 100, 1) AS recall,
  round(avg(CASE WHEN recall > 0 THEN 2 * precision / (precision + 1) ELSE 0 END) * 100, 1) AS f1 FROM x""")
def retrieval_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at_k(spark, sf_dir).agg(*[F.round(F.avg(n) * 100, 1).alias(n) for n in ("precision", "recall", "f1")])


@query("e24_recall_histogram", _AT_K + "SELECT recall, count(*) AS n_queries FROM x GROUP BY recall")
def recall_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at_k(spark, sf_dir).groupBy("recall").agg(F.count("*").alias("n_queries"))
