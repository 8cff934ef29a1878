"""Ranking by vector similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarrylog.functions.vectors import as_double, cosine
from quarrylog.operators.joins import first_per_group, spread_join
from quarrylog.session import cut_lineage

BLOCK_ROWS = 4096
#: Blocks that a side is cut into at most, until a block would hold more than ``MOST_ROWS``: each row is sent to so many tasks.
BLOCKS, MOST_ROWS = 16, 1 << 16
SCORES = 1 << 22  # scores of a task in memory at the same time
CENTRES = 64
SLACK = 1e-6  # more than rounding can move a bound
SCORE_DIGITS = 9  # scores that differ only by summation order rank as ties, then by id


def _unit_rows(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.array(vectors.tolist(), dtype=np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable = norms > 0
    return matrix / np.where(usable, norms, 1.0)[:, None], usable


def best_in_block(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of each row's best ``k`` scores, ties to the smaller id; NaN never ranks."""
    keyed = np.where(np.isnan(scores), -np.inf, scores)
    columns = keyed.shape[1]
    bound = np.partition(keyed, columns - k, axis=1)[:, columns - k] if k < columns else np.full(len(keyed), -np.inf)
    rows, cols = np.nonzero((keyed >= bound[:, None]) & np.isfinite(keyed))
    order = np.lexsort((ids[cols], -keyed[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(rows)) + 1)) if len(rows) else np.array([], dtype=int)
    lengths = np.diff(np.append(first, len(rows)))
    place = np.arange(len(rows)) - np.repeat(first, lengths)
    return rows[place < k], cols[place < k]


def _pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors chosen by a hash of their ids, as unit rows: a sample of bounded size."""
    rows = vectors.where("vector is not null").select("vector", F.xxhash64("id").alias("h")).orderBy("h").head(n)
    matrix = np.array([r.vector for r in rows], dtype=np.float64)
    norms = np.sqrt((matrix * matrix).sum(axis=1)) if len(rows) else np.zeros(0)
    return matrix[norms > 0] / norms[norms > 0, None] if len(rows) else matrix


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _grouped(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id``, unit ``vector``, nearest ``centre`` and the ``angle`` to it; vectors without a direction match nothing and go."""

    def run(frames):
        for frame in frames:
            unit, usable = _unit_rows(frame["vector"])
            frame, unit = frame[usable], unit[usable]
            angles = _angles(unit, pivots) if len(frame) else np.zeros((0, len(pivots)))
            yield pd.DataFrame({"id": frame["id"], "vector": pd.Series(list(unit), index=frame.index, dtype=object), "centre": angles.argmin(axis=1).astype("int32"), "angle": angles.min(axis=1)})

    kind = dict(vectors.dtypes)["id"]
    rows = vectors.where("vector is not null").select("id", as_double(F.col("vector")).alias("vector"))
    return cut_lineage(rows.mapInPandas(run, f"id {kind}, vector array<double>, centre int, angle double"))


@dataclass(frozen=True)
class Layout:
    """Centres packed into cells of about a block, in order: cell, largest angle and presence of targets per centre, blocks of both sides per cell."""

    cell: np.ndarray
    radius: np.ndarray
    held: np.ndarray
    q_blocks: list[int]
    t_blocks: list[int]


def _layout(queries: DataFrame, targets: DataFrame, centres: int, block_rows: int | None = None) -> Layout:
    """Without ``block_rows`` blocks grow with the input, so that the rows sent grow in proportion to it."""
    def sizes(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n, radius = np.zeros(centres, np.int64), np.zeros(centres)
        for r in df.groupBy("centre").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).head(centres):  # a row per centre
            n[r.centre], radius[r.centre] = r.n, r.radius
        return n, radius

    t_rows, radius = sizes(targets)
    q_rows = t_rows if queries is targets else sizes(queries)[0]
    if block_rows is None:
        block_rows = min(MOST_ROWS, max(BLOCK_ROWS, -(-int(max(q_rows.sum(), t_rows.sum())) // BLOCKS)))
    cell, held = np.zeros(centres, np.int64), 0
    for c in range(centres):
        rows = int(max(q_rows[c], t_rows[c]))
        fits = c > 0 and held + rows <= block_rows
        cell[c], held = (cell[c - 1], held + rows) if fits else (cell[c - 1] + 1 if c else 0, rows)
    blocks = lambda rows: np.maximum(0, -(-np.bincount(cell, weights=rows).astype(np.int64) // block_rows)).tolist()
    return Layout(cell, radius, t_rows > 0, blocks(q_rows), blocks(t_rows))


def _scores(q: pd.DataFrame, t: pd.DataFrame, skip_same_id: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of two blocks of unit vectors, some rows of ``q`` at a time with the first one's position; NaN where a pair does not count."""
    ours, theirs = np.array(q["vector"].tolist()), np.array(t["vector"].tolist()).T
    q_ids, t_ids = q["id"].to_numpy(), t["id"].to_numpy()
    step = max(1, SCORES // len(t))
    for at in range(0, len(q), step):
        scores = np.round(ours[at : at + step] @ theirs, SCORE_DIGITS) + 0.0
        if skip_same_id:
            scores[q_ids[at : at + step, None] == t_ids[None, :]] = np.nan
        yield at, scores


def _with_near_centres(queries: DataFrame, targets: DataFrame, pivots: np.ndarray, layout: Layout, k: int, skip_same_id: bool) -> DataFrame:
    """Queries with ``qc`` and ``qb``, their cell and block, and ``near``: the cells whose targets can reach their best ``k``.

    A query meets one block of its own cell first. The ``k``-th score found
    there is a bound from below; by the triangle inequality no target of a centre
    scores more than the cosine of the angle to the centre less the centre's radius.
    """
    of = lambda counts, centre: F.get(F.array(*map(F.lit, counts)), centre)
    salt = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    mine, theirs = of(layout.q_blocks, F.col("cell")), of(layout.t_blocks, F.col("cell"))
    queries, targets = (df.select("id", "vector", of(layout.cell.tolist(), F.col("centre")).alias("cell")) for df in (queries, targets))
    left = queries.withColumn("qb", salt(mine)).withColumn("tb", F.col("qb") % F.greatest(theirs, F.lit(1)))
    meets = F.filter(F.sequence(F.lit(0), mine - 1), lambda b: b % theirs == F.col("tb"))
    right = targets.withColumn("tb", salt(theirs)).where(mine > 0).withColumn("qb", F.explode(meets))

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        bound = np.full(len(q), -2.0)
        if len(q) and len(t):
            for at, found in _scores(q, t, skip_same_id) if len(t) >= k else ():
                kth = np.partition(np.where(np.isnan(found), -np.inf, found), len(t) - k, axis=1)[:, len(t) - k]
                bound[at : at + len(kth)] = np.maximum(-2.0, kth)
        near = np.zeros((0, len(pivots)), bool)
        if len(q):
            most = np.cos(np.maximum(0.0, _angles(np.array(q["vector"].tolist()), pivots) - layout.radius))
            near = (most >= bound[:, None] - SLACK) & layout.held
        cells = [np.unique(layout.cell[row]).astype("int32") for row in near]
        return pd.DataFrame({"id": q["id"], "vector": q["vector"].astype(object), "qc": q["cell"], "qb": q["qb"], "near": pd.Series(cells, index=q.index, dtype=object)})

    keys = ["cell", "qb", "tb"]
    kind = dict(queries.dtypes)["id"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"id {kind}, vector array<double>, qc int, qb int, near array<int>")
    return cut_lineage(met)


def top_similar(
    queries: DataFrame, targets: DataFrame, k: int, block_rows: int | None = None, skip_same_id: bool = False, centres: int = CENTRES
) -> DataFrame:
    """Exact best ``k`` targets of each query by cosine; both sides are ``(id, vector)``.

    Vectors are grouped by the nearest of a bounded sample of ``centres`` and each
    group is cut into blocks of bounded size by a hash of the id; small groups share
    one. A query goes to the blocks of those groups only whose targets can still reach its best ``k``
    (``_with_near_centres``), so well-separated groups never meet. A task scores one
    pair of blocks as a matrix product and hands on only ``k`` rows per query; the
    score matrix never exists as rows and no side is broadcast.
    """
    q_type, t_type = dict(queries.dtypes)["id"], dict(targets.dtypes)["id"]
    schema = f"q_id {q_type}, t_id {t_type}, score double"
    pivots = _pivots(targets, centres)
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    t = _grouped(targets, pivots)
    q = t if queries is targets else _grouped(queries, pivots)
    layout = _layout(q, t, len(pivots), block_rows)
    asked = _with_near_centres(q, t, pivots, layout, k, skip_same_id)

    n_blocks = F.get(F.array(*map(F.lit, layout.t_blocks)), F.col("tc"))
    left = asked.select("id", "vector", "qc", "qb", F.explode("near").alias("tc"))
    groups = left.select(*[F.col(c).alias(c) for c in ("qc", "qb", "tc")]).distinct()
    left = left.withColumn("tb", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    cell = F.get(F.array(*map(F.lit, layout.cell.tolist())), F.col("centre"))
    right = t.select("id", "vector", cell.alias("tc")).withColumn("tb", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
    right = spread_join(right, groups, ["tc"], ["id"]).select("id", "vector", *[F.col(c).alias(c) for c in ("qc", "qb", "tc", "tb")])
    empty = pd.DataFrame({"q_id": [], "t_id": [], "score": []})

    def score(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return empty
        q_ids, t_ids, found = q["id"].to_numpy(), t["id"].to_numpy(), []
        for at, scores in _scores(q, t, skip_same_id):
            rows, cols = best_in_block(scores, t_ids, k)
            found.append(pd.DataFrame({"q_id": q_ids[at + rows], "t_id": t_ids[cols], "score": scores[rows, cols]}))
        return pd.concat(found)

    keys = ["qc", "qb", "tc", "tb"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, schema)
    return first_per_group(partial, ["q_id"], [F.desc("score"), "t_id"], k)


def mean_vectors(vectors: DataFrame, key: str, vector: str, kept: str | None = None) -> DataFrame:
    """V2: mean of the unmasked vectors of each key."""
    rows = vectors.where(kept) if kept else vectors
    cells = rows.select(key, F.posexplode(as_double(F.col(vector))).alias("i", "x"))
    means = cells.groupBy(key, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vector")
    )


def rank_all(vectors: DataFrame, probe: DataFrame) -> DataFrame:
    """Every vector scored against one probe row, best first, ties by id; the sort is distributed."""
    probed = vectors.withColumn("probe", probe.select("vector").scalar())
    score = F.round(cosine(as_double(F.col("vector")), F.col("probe")), SCORE_DIGITS)
    return probed.withColumn("score", score).drop("vector", "probe").orderBy(F.desc_nulls_last("score"), "id")


def slice_suggestions(ranked: DataFrame, suggested: int, extra: int) -> DataFrame:
    """T4/T5: ranks 1..``suggested`` are shown, the next ``extra`` are offered."""
    return ranked.where(F.col("rank") <= suggested + extra).withColumn(
        "slot", F.when(F.col("rank") <= suggested, "suggested").otherwise("extra")
    )


def suggest_tables(gold: DataFrame, ranked: DataFrame, extra: int, known: DataFrame | None = None) -> DataFrame:
    """T4/T5 for tables: the gold tables first, then the best ranked ones not among them.

    ``gold`` is ``(q_id, pos, table_name)``, ``ranked`` ``(q_id, rank, table_name)``.
    With ``known``, only its tables are shown as suggested.
    """
    others = ranked.join(gold.select("q_id", "table_name"), ["q_id", "table_name"], "left_anti")
    offered = first_per_group(others.withColumnRenamed("rank", "_rank"), ["q_id"], ["_rank", "table_name"], extra)
    shown = gold.select("q_id", "table_name", F.col("pos").cast("int").alias("rank"), F.lit("suggested").alias("slot"))
    if known is not None:
        shown = shown.join(known.select("table_name").distinct(), "table_name", "left_semi").select(*shown.columns)
    return shown.unionByName(offered.select("q_id", "table_name", "rank", F.lit("extra").alias("slot")))
