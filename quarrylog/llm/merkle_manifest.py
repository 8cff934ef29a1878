"""Merkle manifest of a dataset: leaves, subroots per group, one root, and inclusion proofs, by lag and lead windows.

A leaf is the digest of a row's fields. Leaves of a group stand in the order of
their ids; every ``ARITY`` consecutive nodes become their digest, level by
level, until one is left: the group's subroot. Subroots become the root in the
same way.

A row is numbered within its group without one task seeing the whole group: the
rows are sorted by range, numbered per partition, and a small table of partition
sizes gives each partition its offset. Positions are dense, so the sibling that
is ``o`` nodes away on a level stands a fixed number of rows away: lag and lead
columns of fixed offsets, masked by the node's slot in its run and by the run's
length, hold all siblings, and the row of a first child hashes the parent. A
window covers a block of ``ARITY ** LEVELS`` leaves, so ``LEVELS`` levels cost one
exchange and no group meets in one task; blocks are then the leaves of the next
stage. What lies above a block is joined to it once, on the block.

Defined cases: a null field is ``-``. A null id comes first. A null group is a
group of its own and comes first. Rows of one id are ordered by their leaf, so
equal rows may swap places without any change. A group of one row has its leaf
as subroot and no steps below it. An empty table gives an empty result. Columns
that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylog.session import cut_lineage

ARITY = 8
LEVELS = 3
_BITS = 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Partition offsets (one row per partition, and one more per group) are broadcast up to this many rows.
BROADCAST_ROWS = 50_000
STEPS = "array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields, each ``-`` or its length in bytes, a colon and its value."""
    packed = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*packed), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in their group from 0, and ``n``, the group's number of rows."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    sizes = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_m"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_m").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut_lineage(sizes.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_m").over(whole).alias("n")))
    few = offsets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = dealt.join(F.broadcast(offsets) if few else offsets, [group, "_part"])
    return placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def _levels(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``block``, ``steps`` of up to ``LEVELS`` levels and, on each block's first row, ``top``: the block's digest."""
    window = Window.partitionBy("grp", "block").orderBy("pos")
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    rows = nodes.withColumn("block", F.shiftright("pos", _BITS * LEVELS)).withColumn("_h0", F.col("node"))
    for level in range(LEVELS):
        stride, here = ARITY**level, f"_h{level}"
        index, count = F.shiftright("pos", _BITS * level), F.shiftright(F.col("n") + (stride - 1), _BITS * level)
        slot = index % ARITY
        run = F.least(F.lit(ARITY), count - index + slot)
        left = [F.when(slot >= o, F.lag(here, o * stride).over(window)) for o in range(ARITY - 1, 0, -1)]
        right = [F.when(slot + o < run, F.lead(here, o * stride).over(window)) for o in range(1, ARITY)]
        rows = rows.withColumns({"_left": F.concat_ws("", *left), "_right": F.concat_ws("", *right), "_grows": count > 1})
        step = F.when((F.col("pos") % stride == 0) & F.col("_grows"), F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
        # Rows below a node take its step from the row of its first leaf.
        step = F.last(step, ignorenulls=True).over(so_far) if level else step
        parent = F.when(F.col("_grows"), F.sha2(F.concat(here, "_right"), 256)).otherwise(F.col(here))
        rows = rows.withColumns({f"_s{level}": step, f"_h{level + 1}": F.when(F.col("pos") % (stride * ARITY) == 0, parent)})
    steps = F.filter(F.array(*[f"_s{level}" for level in range(LEVELS)]), lambda s: s.isNotNull())
    return rows.select(*nodes.columns, "block", steps.alias("steps"), F.col(f"_h{LEVELS}").alias("top"))


def _climb(nodes: DataFrame, most: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` (``grp, pos, n, node``; groups of up to ``most``) with ``steps``, ``subroot`` and ``root``. ``crown`` gives what lies above subroots."""
    if most <= 1:  # one node per group
        above = crown(nodes.select("grp", "pos", "n", "node")).select("grp", "steps", "subroot", "root")
        return nodes.join(above, "grp").select(*nodes.columns, "steps", "subroot", "root")
    staged = _levels(nodes)
    blocks = staged.where(F.col("pos") % BLOCK == 0)
    blocks = cut_lineage(blocks.select("grp", F.col("block").alias("pos"), F.shiftright(F.col("n") + (BLOCK - 1), _BITS * LEVELS).alias("n"), F.col("top").alias("node")))
    above = _climb(blocks, -(-most // BLOCK), crown).select("grp", F.col("pos").alias("block"), F.col("steps").alias("_above"), "subroot", "root")
    both = staged.join(above.hint("shuffle_hash"), ["grp", "block"])
    return both.select(*nodes.columns, F.concat("steps", "_above").alias("steps"), "subroot", "root")


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def _root(subroots: DataFrame) -> DataFrame:
    """``grp, steps, subroot, root`` of ``subroots`` (one ``node`` per ``grp``), as a tree of one group in the order of ``grp``."""
    nodes = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("_grp"), "node"), "grp", ["_grp"])
    done = _climb(nodes, _most(nodes), lambda top: top.select("grp", F.array().cast(STEPS).alias("steps"), F.col("node").alias("subroot"), F.col("node").alias("root")))
    return done.select(F.col("_grp").alias("grp"), "steps", F.col("node").alias("subroot"), "root")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, steps`` and the columns of ``carry``.

    ``steps`` holds, level by level from the leaf to the root, the digests left
    and right of the node, as they are joined when the parent is hashed.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    carried = [c.alias(name) for name, c in (carry or {}).items()]
    rows = docs.select(F.col(id_col).alias("_id"), group.alias("grp"), leaf([F.col(f) for f in fields]).alias("node"), *carried)
    nodes = numbered(rows, "grp", ["_id", "node"])
    done = _climb(nodes, _most(nodes), _root)
    return done.select(F.col("_id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", "steps", *(carry or {}))


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof(steps: Column) -> Column:
    """All sibling digests of a row in one string, level by level."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")
