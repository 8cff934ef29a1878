"""Reduced vectors and clusters: against numpy, and on clusters that are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.operators import clustering


def frame(spark, matrix):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return clustering.with_features(spark.createDataFrame(rows, "i long, vector array<double>"), "vector").select("i", "features")


@pytest.fixture(scope="module")
def planted():
    """Five round groups of 30 points, far apart."""
    rng = np.random.default_rng(1)
    centres = rng.normal(scale=20, size=(5, 6))
    return np.repeat(centres, 30, axis=0) + rng.normal(scale=0.5, size=(150, 6)), np.repeat(np.arange(5), 30)


def test_variance_like_numpy(spark):
    matrix = np.random.default_rng(2).normal(size=(200, 8)) @ np.diag([5, 4, 3, 2, 1, 0.5, 0.2, 0.1])
    _, variance = clustering.pca(frame(spark, matrix), 8)
    got = variance.orderBy("k").collect()
    values = np.sort(np.linalg.eigvalsh(np.cov(matrix.T)))[::-1]
    assert [r["share"] for r in got] == pytest.approx((values / values.sum()).tolist())
    assert [r["cumulative"] for r in got] == pytest.approx(np.cumsum(values / values.sum()).tolist())


def test_reduced_vectors_keep_distances(spark):
    matrix = np.random.default_rng(4).normal(size=(40, 3)) @ np.random.default_rng(5).normal(size=(3, 9))
    reduced, _ = clustering.pca(frame(spark, matrix), 3)
    got = np.array([r["features"].toArray() for r in reduced.orderBy("i").collect()])
    assert np.linalg.norm(got[0] - got[1:], axis=1) == pytest.approx(np.linalg.norm(matrix[0] - matrix[1:], axis=1))


def test_planted_clusters_are_found(spark, planted):
    matrix, truth = planted
    labels = {r["i"]: r["cluster"] for r in clustering.kmeans(frame(spark, matrix), 5, restarts=4).collect()}
    pairs = {(int(truth[i]), c) for i, c in labels.items()}
    assert len(labels) == 150 and len(pairs) == 5 and len({c for _, c in pairs}) == 5


def test_silhouette_by_hand(spark, planted):
    matrix, truth = planted
    labelled = frame(spark, matrix).withColumn("cluster", (F.col("i") / 30).cast("int"))
    squared = ((matrix[:, None] - matrix[None]) ** 2).sum(2)
    mean = np.stack([squared[:, truth == c].sum(1) / np.where(truth == c, (truth == c).sum() - 1, (truth == c).sum()) for c in range(5)], 1)
    own = mean[np.arange(150), truth]
    other = np.where(np.eye(5, dtype=bool)[truth], np.inf, mean).min(1)
    assert clustering.silhouette(labelled) == pytest.approx(((other - own) / np.maximum(own, other)).mean(), abs=0.02)


def test_sweep_prefers_the_planted_number(spark, planted):
    swept = {r["k"]: r["silhouette"] for r in clustering.kmeans_sweep(frame(spark, planted[0]), [2, 3, 5, 8], restarts=4).collect()}
    assert max(swept, key=swept.get) == 5


def test_more_starts_are_no_worse(spark):
    matrix = np.random.default_rng(7).normal(size=(120, 4))
    points = frame(spark, matrix)

    def cost(restarts):
        model = clustering._cheapest(points, [9], restarts, 1)[0]
        return model.summary.trainingCost

    assert cost(10) <= cost(1) + 1e-9
