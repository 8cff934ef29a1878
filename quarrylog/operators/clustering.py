"""Vector clusters, term statistics of clusters, near-duplicate templates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrylog.operators import term_blocks as blocks, term_vectors as vectors
from quarrylog.operators.joins import first_per_group, spread_join
from quarrylog.session import cut_lineage, stored

PARALLEL_FITS = 8  # models fitted at the same time; the executors share their cores among them


def with_features(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.withColumn("features", array_to_vector(vector))


def pca(features: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The first ``k`` components of every row, and explained variance with its running sum."""
    model = PCA(k=k, inputCol="features", outputCol="reduced").fit(features)
    # One row per component.
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    variance = features.sparkSession.createDataFrame(shares, "k int, share double")
    window = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reduced = model.transform(features).drop("features").withColumnRenamed("reduced", "features")
    return reduced, variance.withColumn("cumulative", F.sum("share").over(window))


def _at_once(task: Callable, inputs: list) -> list:
    """``task`` of every input, a few Spark jobs at a time; only models and scores come back."""
    with ThreadPool(PARALLEL_FITS) as pool:
        return pool.map(inheritable_thread_target(task), inputs, chunksize=1)


def _cheapest(features: DataFrame, ks: list[int], restarts: int, seed: int) -> list[KMeansModel]:
    """For each number of clusters the cheapest of ``restarts`` runs (k-means|| start)."""

    def fit(run: tuple[int, int]) -> KMeansModel:
        return KMeans(k=run[0], seed=seed + run[1], featuresCol="features", predictionCol="cluster").fit(features)

    models = _at_once(fit, [(k, start) for k in ks for start in range(restarts)])
    runs = [models[i : i + restarts] for i in range(0, len(models), restarts)]
    return [min(run, key=lambda m: m.summary.trainingCost) for run in runs]


def kmeans(features: DataFrame, k: int, restarts: int = 10, seed: int = 1) -> DataFrame:
    """M2/M4: labels of the cheapest of ``restarts`` runs."""
    stored = cut_lineage(features)
    return _cheapest(stored, [k], restarts, seed)[0].transform(stored)


def silhouette(labelled: DataFrame) -> float:
    """M3: mean silhouette on squared Euclidean distance."""
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(labelled)


def kmeans_sweep(features: DataFrame, ks: list[int], restarts: int = 10, seed: int = 1) -> DataFrame:
    """M2/M3: silhouette for each number of clusters."""
    stored = cut_lineage(features)
    models = _cheapest(stored, ks, restarts, seed)
    scores = _at_once(lambda model: silhouette(model.transform(stored)), models)
    return features.sparkSession.createDataFrame(list(zip(ks, scores, strict=True)), "k int, silhouette double")


def term_counts(docs: DataFrame, keys: list[str], tokens: Column, n: int) -> DataFrame:
    """``(*keys, term, tf)``, keys being cluster and document: n-grams of each document; documents of equal keys count together.

    Whole texts are shuffled once and sorted by key; n-grams are counted where
    the texts are, a chunk of documents at a time.
    """
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for chunk in blocks.chunks(batches, n):
            cluster = pa.array(chunk.clusters, arrow.field(0).type).take(pa.array(chunk.doc_cluster))
            key = pa.array(chunk.docs, arrow.field(1).type)
            for start in range(0, len(chunk.doc), blocks.SLICE):
                doc, term = (pa.array(x[start : start + blocks.SLICE]) for x in (chunk.doc, chunk.term))
                columns = [cluster.take(doc), key.take(doc), chunk.texts.take(term).cast(arrow.field("term").type), pa.array(chunk.tf[start : start + blocks.SLICE])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    cluster, key = keys
    return blocks.dealt(docs, key, cluster, tokens).mapInArrow(run, schema)


def _sizes(docs: DataFrame, cluster: str) -> DataFrame:
    return docs.groupBy(cluster).agg(F.count("*").alias("docs"))


def tfidf(
    docs: DataFrame, key: str, cluster: str, tokens: Column, n: int = 1, min_df: int = 1, max_share: float = 1.0
) -> DataFrame:
    """M6: ``(cluster, key, term, df, w)``: n-gram weights inside each cluster, documents scaled to unit length.

    idf is ``ln((1 + docs) / (1 + df)) + 1``. Terms outside ``min_df`` to
    ``max_share`` of the documents are left out first.
    """
    rows, parts = blocks.counted(docs, key, cluster, tokens, n)
    table, _ = stored(rows)
    answers, _ = stored(blocks.answered(table, parts))
    places, number = blocks.placed(table)
    texts = table.where("part >= 0").select("chunk", "part", "text", "lengths")
    counts = blocks.with_sizes(table, _sizes(docs, cluster), cluster).drop("text", "lengths")
    dealt = blocks.to_blocks(counts, answers.join(texts, ["chunk", "part"]), places, number)
    schema = T.StructType(
        [docs.schema[cluster], docs.schema[key], T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("w", T.DoubleType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        for _, rows in blocks.grouped(batches, "block"):
            *told, row = rows
            total = np.concatenate([blocks.unpack(x["total"]) for x in told])
            text = pa.concat_arrays([blocks.unpack_texts(x["text"], x["lengths"]) for x in told])
            doc, term, w, no = blocks.weights_of(row, total, min_df, max_share)
            clusters, keys = pa.array(row["clusters"], arrow.field(0).type), pa.array(row["keys"], arrow.field(1).type)
            for start in range(0, len(doc), blocks.SLICE):
                some = slice(start, start + blocks.SLICE)
                at = term[some]
                columns = [clusters.take(pa.array(no[at])), keys.take(pa.array(doc[some])), text.take(pa.array(at)).cast(arrow.field(2).type), pa.array(total[at].astype(np.int64)), pa.array(w[some])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return dealt.mapInArrow(run, schema)


def _sums_of_chunks(dealt: DataFrame, top: int) -> DataFrame:
    """For every chunk and part the sums of the terms' weights.

    A term that is in no other chunk has its whole sum there. Of those only
    the ``top`` of each cluster are told: as many others are ahead of the rest.
    """

    def run(batches):
        for _, rows in blocks.grouped(batches, "block"):
            *answers, row = rows
            totals = [blocks.unpack(x["total"]) for x in answers]
            total = np.concatenate(totals).astype(np.int64)
            doc, term, w, cluster = blocks.weights_of(row, total, 1, 1.0)
            sums = np.bincount(term, w, minlength=len(total))
            alone = np.flatnonzero(np.bincount(term, minlength=len(total)) == total)
            told = np.ones(len(total), bool)
            told[alone] = blocks.leading(sums[alone], cluster[alone], top)
            ends = np.cumsum([len(x) for x in totals])
            for x, start, end in zip(answers, ends - [len(x) for x in totals], ends, strict=True):
                own = told[start:end]
                yield {"chunk": x["chunk"], "part": x["part"], "told": blocks.pack(np.packbits(own)), "sums": blocks.pack(sums[start:end][own])}

    return blocks.packed(dealt, run, "chunk long, part int, told binary, sums binary")


def _sums_of_terms(table: DataFrame, sums: DataFrame, parts: int, cluster: T.StructField, top: int) -> DataFrame:
    """The sum of each term that may be among the ``top`` of its cluster."""
    texts = table.where("part >= 0").select("chunk", "part", "entries", "clusters", "text", "lengths", "cluster_no")

    def run(batches):
        for _, rows in blocks.grouped(batches, "part"):
            rows = list(rows)
            sent = {row["chunk"]: row for row in rows if row["sums"] is not None}
            asked = [row for row in rows if row["sums"] is None]
            entries, terms, no, clusters = blocks.known_terms(asked)
            told = np.concatenate([np.unpackbits(blocks.unpack(sent[row["chunk"]]["told"]), count=row["entries"]) for row in asked])
            entries, values = entries[told == 1], np.concatenate([blocks.unpack(sent[row["chunk"]]["sums"]) for row in asked])
            shown = np.flatnonzero(np.bincount(entries, minlength=len(terms)))
            total = np.bincount(entries, values, minlength=len(terms))[shown]
            first = blocks.leading(total, no[shown], top)
            for at, score in zip(shown[first].tolist(), total[first].tolist(), strict=True):
                yield {cluster.name: clusters[no[at]], "term": terms[at].as_py(), "score": score}

    schema = T.StructType([cluster, T.StructField("term", T.StringType()), T.StructField("score", T.DoubleType())])
    return blocks.packed(blocks.to_owners(texts.unionByName(sums, allowMissingColumns=True), parts, "chunk"), run, schema)


def cluster_terms(docs: DataFrame, key: str, cluster: str, tokens: Column, n: int = 2, top: int = 20) -> DataFrame:
    """Per cluster the ``top`` n-grams by summed TF-IDF (the weights of ``tfidf``, summed where the counts are)."""
    rows, parts = blocks.counted(docs, key, cluster, tokens, n)
    table, forget_table = stored(rows)
    answers, forget_answers = stored(blocks.answered(table, parts))
    places, number = blocks.placed(table)
    dealt = blocks.to_blocks(blocks.with_sizes(table, _sizes(docs, cluster), cluster), answers, places, number)
    best, _ = stored(_sums_of_terms(table, _sums_of_chunks(dealt, top), parts, docs.schema[cluster], top))
    forget_table()
    forget_answers()
    return first_per_group(best.withColumn("score", F.round("score", 9)), [cluster], [F.desc("score"), "term"], top)


def _weighted_sums(rows: DataFrame, by: str, vector: str, size: int, *more: Column) -> DataFrame:
    """Per ``by`` the sum of ``w`` times the vector, element by element."""
    return rows.groupBy(by).agg(F.array(*[F.sum(F.col("w") * F.col(vector)[j]) for j in range(size)]).alias(vector), *more)


#: Terms that each hold more than this share of all weights are broadcast with their vectors; there are fewer than that.
COMMON = 1 << 15


def _sums_of_documents(weights: DataFrame, by_term: DataFrame, key: str, size: int, total: int) -> DataFrame:
    """Per document the weighted sum of its terms' vectors.

    Common terms come to the weights, where a document's rows lie together and
    are added up before they are sent; only rows of rare terms travel with a vector.
    """
    common = F.col("df") * COMMON > total
    near = weights.where(common).join(F.broadcast(by_term.where(common).select("term", "v")), "term")
    far = weights.where(~common).join(by_term.where(~common).select("term", "v"), "term")
    return _weighted_sums(near.unionByName(far), key, "v", size)


def latent_terms(
    docs: DataFrame, key: str, tokens: Column, dims: int = 20, min_df: int = 5, max_share: float = 0.5, rounds: int = 2
) -> DataFrame:
    """M5: TF-IDF reduced to ``dims`` by truncated SVD, documents scaled to unit length.

    Randomised subspace iteration on the sparse rows, so the vocabulary has no
    limit; only matrices of ``dims + 10`` squared reach the driver. The counts
    lie in blocks of documents. In a step a block adds up its terms' vectors
    and sends one for each term to the owner of the term's part, which sends
    the sum over all blocks back; shuffle files go after each stripe. The start
    directions come from hashes of the terms, so a second run gives the same
    result.
    """
    n_docs = docs.count()
    rows, parts = blocks.counted(docs.withColumn("_all", F.lit(0)), key, "_all", tokens, 1, hashed=True)
    table, forget_table = stored(rows)
    answers, forget_answers = stored(blocks.answered(table, parts, (min_df, max_share * n_docs)))
    places, number = blocks.placed(table, vectors.BLOCK)
    sizes = docs.sparkSession.createDataFrame([(0, n_docs)], "_all int, docs long")
    dealt = blocks.to_blocks(blocks.with_sizes(table, sizes, "_all"), answers, places, number)
    of_key = docs.schema[key].dataType
    counts, forget_counts = stored(vectors.blocks_of_counts(dealt, of_key, min_df, max_share))
    forget_table()
    forget_answers()

    def step(turn: np.ndarray | None) -> tuple[DataFrame, list[Callable]]:
        """The documents' sums of the terms' sums of their vectors, or of the start; some elements at a time, so that no more is sent at once."""
        size, found = dims + 10 if turn is None else turn.shape[1], []
        for stripe, low in enumerate(range(0, size, vectors.STRIPE)):
            high, back = min(low + vectors.STRIPE, size), None
            if turn is not None:
                met = vectors.in_blocks(counts.drop("hashes"), basis.drop("keys"), number)
                by_term = blocks.to_owners(vectors.sums_by_term(met, n_docs, turn[:, low:high]), parts, "block")
                back = vectors.back_to_blocks(by_term, high - low)
            met = vectors.in_blocks(counts if back is None else counts.drop("hashes"), back, number)
            found.append(stored(vectors.sums_by_document(met, n_docs, of_key, stripe, low, high)))
        return reduce(DataFrame.unionByName, [table for table, _ in found]), [forget for _, forget in found]

    basis, forget_basis = step(None)
    size = dims + 10
    for done in range(rounds + 1):
        turn = vectors.orthonormal(vectors.gram(basis, size, number))
        size = turn.shape[1]
        after, forget_after = step(turn)
        if done < rounds:
            for forget in forget_basis:
                forget()
            basis, forget_basis = after, forget_after
    values, directions = np.linalg.eigh(vectors.gram_of_terms(basis, after, turn, number))
    for forget in (forget_counts, *forget_after):
        forget()
    largest = np.argsort(values)[::-1][:dims]
    turned = directions[:, largest] * np.sqrt(np.maximum(values[largest], 0))
    # One sign per direction: its largest entry is positive.
    turned = turned * np.sign(turned[np.abs(turned).argmax(axis=0), np.arange(turned.shape[1])])
    schema = T.StructType([docs.schema[key], T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for keys, own, _ in vectors.whole(batches):
            own = own @ turn @ turned
            length = np.sqrt((own * own).sum(axis=1))
            for at in np.flatnonzero(length > 0).tolist():
                yield {key: keys[at], "vector": (own[at] / length[at]).tolist()}

    placed = blocks.packed(vectors.in_blocks(basis, None, number), run, schema)
    # Documents without a kept term stay at the origin.
    origin = F.array_repeat(F.lit(0.0), turned.shape[1])
    return docs.select(key).join(placed, key, "left").select(key, F.coalesce("vector", origin).alias("vector"))


HEADS = 8  # first queries of a token group looked at in one round


def _alike(a: str, b: str, threshold: float) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)) > threshold


def leader_templates(log: DataFrame, key: str, sql: str, threshold: float = 0.8) -> DataFrame:
    """V5: queries that no earlier leader resembles (token overlap above ``threshold``), in key order.

    Two token sets that overlap that much share a token of each other's prefix:
    the first ``size - floor(threshold * size)`` tokens in one global order
    (rare tokens first). Each round looks at the first ``HEADS`` undecided
    queries of every prefix token. New leaders are those that are heads of all
    their tokens and resemble no earlier head; what resembles a new leader is
    dropped. A token group hands its members at most ``HEADS`` leaders per
    round, so its pairs are never formed and a hot token is cut to its heads
    before it is shuffled. The outcome equals one sequential scan. The first
    undecided query heads all its groups, so every round decides some.
    """
    tokens = log.select(key, F.array_sort(F.array_distinct(F.split(sql, " "))).alias("tokens"))
    # Equal token sets resemble each other, so only the first of each set can lead.
    sets = cut_lineage(tokens.groupBy("tokens").agg(F.min(key).alias(key)))
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    total = sets.groupBy().count().scalar()
    # Tokens in over a 64th of the sets: no more of them than 64 times the mean set size.
    common = counts.where(F.col("df") * 64 > total)
    ranks = common.agg(F.map_from_entries(F.collect_list(F.struct("token", "df"))).alias("m"))
    weighted = sets.withColumn("_m", ranks.select("m").scalar())
    by_rarity = F.transform(
        F.array_sort(
            F.transform("tokens", lambda t: F.struct(F.coalesce(F.try_element_at(F.col("_m"), t), F.lit(0)).alias("df"), t.alias("t")))
        ),
        lambda s: s["t"],
    )
    size = F.size("tokens")
    prefix = F.slice(by_rarity, F.lit(1), size - F.ceil(size * threshold - 1e-9).cast("int") + 1)
    undecided = cut_lineage(weighted.select(key, "tokens", prefix.alias("prefix")))
    leaders = None
    while True:
        rows = undecided.select(key, "tokens", "prefix", F.explode("prefix").alias("token"))
        sizes = rows.groupBy("token").agg(F.count("*").alias("n"))
        heads = cut_lineage(first_per_group(rows, ["token"], [key], HEADS, "_pos").drop("_pos"))
        earlier = heads.select("token", F.col(key).alias("before"), F.col("tokens").alias("other"))
        blocked = heads.join(earlier, "token").where((F.col("before") < F.col(key)) & _alike("tokens", "other", threshold))
        # A query leads if it is among the heads of all its groups and like no earlier one there.
        led = heads.groupBy(key).agg(F.count("*").alias("groups"), F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix"))
        sure = led.where(F.col("groups") == F.size("prefix")).join(blocked.select(key).distinct(), key, "left_anti")
        new = cut_lineage(sure.select(key, "tokens", "prefix"))
        leaders = new.select(key) if leaders is None else leaders.unionByName(new.select(key))
        shown = new.select(F.col(key).alias("leader"), F.col("tokens").alias("other"), F.explode("prefix").alias("token"))
        met = spread_join(
            rows.drop("prefix"), shown.join(sizes, "token"), ["token"], [key], n="n", total=rows.groupBy().count().scalar()
        )
        covered = met.where((F.col("leader") < F.col(key)) & _alike("tokens", "other", threshold)).select(key).distinct()
        rest = undecided.join(new.select(key), key, "left_anti").join(covered, key, "left_anti")
        undecided = cut_lineage(rest)
        if undecided.isEmpty():
            return leaders
