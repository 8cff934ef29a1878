"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrylog.session import cut_lineage


def _star(edges: DataFrame) -> DataFrame:
    """Every edge ``(u, v)`` of a node hung on the least node around it; nodes meet as minima, never as lists."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = edges.join(least, "u")
    return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return hung.select("e.*").where("u <> v")


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` of every linked node; a component is its least node. Ends with an error if not stable in ``max_rounds`` (they grow as the square of the logarithm of the longest chain)."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    mark = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = cut_lineage(_small_star(_star(both).where("u <> v").distinct()).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError("components did not settle")
