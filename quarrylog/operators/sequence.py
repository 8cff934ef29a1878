"""Order-dependent work over long sequences: numbering, previous row, running sums.

A window over one user or one file would put a hot key into a single task.
Here the rows are range-partitioned on the whole ordering (key, then order,
then a unique id), so a hot key spans many partitions, and only one summary
row per partition crosses the boundaries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylog.operators.joins import first_per_group
from quarrylog.session import cut_lineage

_INDEX_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted on ``order`` (must end in a unique column), with ``_part`` and ``_idx``.

    Written once: the range bounds come from a sample, so a second run could
    place rows elsewhere.
    """
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", _INDEX_BITS).cast("int"))
        .withColumn("_idx", F.col("_id").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)))
        .drop("_id")
    )
    return cut_lineage(numbered)


def _before(per_part: DataFrame, value: str) -> DataFrame:
    """Sum of ``value`` over earlier partitions; one row per partition of the sequence."""
    window = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", F.coalesce(F.sum(value).over(window), F.lit(0)).alias("_before"))


def with_position(seq: DataFrame, out: str = "pos") -> DataFrame:
    """Dense 1-based position over the whole sequence."""
    sizes = seq.groupBy("_part").agg(F.count("*").alias("_n"))
    return seq.join(F.broadcast(_before(sizes, "_n")), "_part").withColumn(
        out, F.col("_idx") + F.col("_before") + 1
    ).drop("_before")


def with_previous(
    seq: DataFrame, columns: list[str], group: list[str] = (), prefix: str = "prev_", depth: int = 1
) -> DataFrame:
    """Values of ``columns`` in the row before, null at the start of a ``group``; ``_first`` marks such starts.

    With ``depth`` above 1, also of the rows before that, as ``{prefix}2_...``.
    """
    carried = F.struct(*columns, *group)
    window = Window.partitionBy("_part").orderBy("_idx")
    backs = range(1, depth + 1)
    # The first rows of a partition look back into earlier ones: a table of the
    # edge rows, at most 2 * depth per partition, holds all they can reach.
    heads = seq.where(F.col("_idx") < depth).select("_part", "_idx", carried.alias("_row"))
    tails = first_per_group(seq.select("_part", "_idx", carried.alias("_row")), ["_part"], [F.desc("_idx")], depth, "_k")
    edges = heads.unionByName(tails.drop("_k")).groupBy("_part", "_idx").agg(F.first("_row").alias("_row"))
    along = Window.orderBy("_part", "_idx")
    reached = edges.select("_part", "_idx", *[F.lag("_row", b).over(along).alias(f"_edge{b}") for b in backs])
    reached = reached.where(F.col("_idx") < depth)
    rows = seq.select("*", *[F.lag(carried, b).over(window).alias(f"_row{b}") for b in backs])
    joined = rows.join(F.broadcast(reached), ["_part", "_idx"], "left")

    def same_group(row: Column) -> Column:
        return reduce(lambda a, name: a & row[name].eqNullSafe(F.col(name)), group, row.isNotNull())

    found = {b: F.coalesce(f"_row{b}", f"_edge{b}") for b in backs}
    return joined.select(
        *seq.columns,
        (~same_group(found[1])).alias("_first"),
        *[
            F.when(same_group(found[b]), found[b][c]).alias(f"{prefix}{c}" if b == 1 else f"{prefix}{b}_{c}")
            for b in backs
            for c in columns
        ],
    )


def with_running_sum(seq: DataFrame, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` from the start of the sequence to this row."""
    valued = seq.withColumn("_v", value)
    window = Window.partitionBy("_part").orderBy("_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = valued.groupBy("_part").agg(F.sum("_v").alias("_s"))
    return (
        valued.withColumn("_w", F.sum("_v").over(window))
        .join(F.broadcast(_before(sums, "_s")), "_part")
        .withColumn(out, F.col("_w") + F.col("_before"))
        .drop("_v", "_w", "_before")
    )


def runs(seq: DataFrame, starts: Column) -> DataFrame:
    """``run`` numbers the stretches that begin where ``starts`` is true; ``offset`` counts from 0 inside one.

    The first row of the sequence must be a start.
    """
    marked = seq.withColumn("_start", starts)
    opened = F.max(F.when(F.col("_start"), F.col("_idx")))
    started = F.sum(F.col("_start").cast("long"))
    # One summary row per partition: its size, its starts, and where the last one is.
    parts = marked.groupBy("_part").agg(F.count("*").alias("_n"), started.alias("_s"), opened.alias("_o"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select(
        "_part",
        "_o",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_runs_before"),
    )
    edges = placed.select(
        "_part", "_rows_before", "_runs_before", F.max(F.col("_rows_before") + F.col("_o")).over(earlier).alias("_open_before")
    )
    window = Window.partitionBy("_part").orderBy("_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marked.withColumn("_runs", started.over(window)).withColumn("_open", opened.over(window))
    position = F.col("_rows_before") + F.col("_idx")
    opening = F.coalesce(F.col("_rows_before") + F.col("_open"), F.col("_open_before"))
    return rows.join(F.broadcast(edges), "_part").select(
        *seq.columns, (F.col("_runs_before") + F.col("_runs")).alias("run"), (position - opening).alias("offset")
    )
