"""Log operators on file streams; the column expressions are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog.functions import sqltext
from quarrylog.session import new_shared_path


def ingest_statements(lines: DataFrame) -> DataFrame:
    """Tab-separated ``(id, sql)`` lines to statements, noise dropped."""
    parts = F.split("value", "\t", 2)
    rows = lines.select(parts[0].cast("long").alias("query_id"), parts[1].alias("sql"))
    return rows.where(sqltext.is_statement(F.col("sql")))


def templates_per_window(log: DataFrame, ts: str, sql: str, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """R2: statements per template and window."""
    timed = log.select(F.col(ts).cast("timestamp").alias("ts"), sqltext.mask_literals(F.col(sql)).alias("template"))
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = timed.withWatermark("ts", delay).groupBy(window.alias("w"), "template").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "template", "n")


def first_seen(log: DataFrame, ts: str, sql: str, delay: str | None = None) -> DataFrame:
    """Each SQL text once.

    Without ``delay`` a text is never handed on again: the state keeps every text
    that was seen, on disk in a ``state_session``. With it a text is forgotten, and
    may come again, once the watermark has passed its first time by ``delay``.
    """
    if delay is None:
        return log.select(sql).dropDuplicates([sql])
    timed = log.select(F.col(ts).cast("timestamp").alias("ts"), sql)
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark([sql]).select(sql)


def run_available(spark: SparkSession, streamed: DataFrame, mode: str, keys: list[str] = ()) -> DataFrame:
    """Run a stream over the files there are and read back what it wrote.

    Append streams go to a parquet sink. Update streams write each batch to its
    own folder, so a batch that runs again replaces itself; the last value of
    each key is read. Complete streams leave their last batch, with what the
    watermark has not closed yet. A stream without any batch gives no rows.
    """
    out, state = new_shared_path(spark, "stream-out"), new_shared_path(spark, "stream-state")
    writer = streamed.writeStream.trigger(availableNow=True).option("checkpointLocation", state)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(out)
        query.awaitTermination()
        return spark.read.schema(streamed.schema).parquet(out)

    written = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written.append(batch_id)

    query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], streamed.schema)
    if mode == "complete":
        return spark.read.parquet(f"{out}/batch={max(written)}")
    values = [c for c in streamed.columns if c not in keys]
    latest = F.max_by(F.struct(*values), "batch").alias("latest")
    return spark.read.parquet(out).groupBy(*keys).agg(latest).select(*keys, "latest.*")
