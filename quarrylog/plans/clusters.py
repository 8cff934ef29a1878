"""Clusters of vectors, their terms, and near-duplicate templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog.functions import sqltext, text
from quarrylog.inputs import embeddings, query_log, table
from quarrylog.operators import clustering as ops
from quarrylog.operators.compute import once
from quarrylog.registry import query


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_features(embeddings(spark, sf_dir), "embedding").select("vec_id", "features")


@query("m1_explained_variance")
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components."""
    _, variance = ops.pca(features(spark, sf_dir), 64)
    return variance.select("k", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


@query("m2_silhouette_sweep")
def silhouette_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M3 on the reduced vectors: every number of clusters, the best of ten starts each."""
    reduced, _ = ops.pca(features(spark, sf_dir), 53)
    swept = ops.kmeans_sweep(reduced, list(range(2, 21)))
    return swept.select("k", F.round("silhouette", 6).alias("silhouette"))


@query("m4_cluster_labels")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced, _ = ops.pca(features(spark, sf_dir), 53)
    return ops.kmeans(reduced, 15).select("vec_id", "cluster")


@query("m5_latent_terms")
def latent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    latent = ops.latent_terms(docs, "doc_id", text.words(F.lower("text")))
    return latent.select("doc_id", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


_GRAMS = r"""t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
 g AS (SELECT lang, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM t WHERE len(w) >= 2),
 tf AS (SELECT lang, doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
 df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL),
 n AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang),
 w AS (SELECT lang, doc_id, term, tf * (ln((1 + docs) / (1 + df)) + 1) AS w FROM tf JOIN df USING (lang, term) JOIN n USING (lang)),
 z AS (SELECT lang, doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
 s AS (SELECT lang, term, round(sum(w / norm), 9) AS score FROM w JOIN z USING (lang, doc_id) GROUP BY ALL)"""


@query("a30_cluster_terms", f"WITH {_GRAMS} SELECT lang, term, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) <= 20")
def cluster_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams of each language's documents, whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    best = ops.cluster_terms(docs, "doc_id", "lang", tokens)
    return best.select("lang", "term", F.round("score", 6).alias("score"))


@query("v5_leader_templates")
def leader_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct queries over more than one table, first by query id."""
    log = query_log(spark, sf_dir)
    distinct = log.groupBy("gold_sql").agg(F.min("query_id").alias("query_id"))
    several = once(distinct, n_tables=F.size(sqltext.table_refs(F.col("gold_sql")))).where("n_tables > 1")
    return ops.leader_templates(several, "query_id", "gold_sql")
