"""Exact dedup by a stateful stream, with DataFrame functions only.

A narrow table of (digest, id) rows is streamed through a keyed aggregation
whose state lives on disk (RocksDB) and never expires. Per digest it keeps the
stable identifier (the id that stays: the largest), the content locator (the id
of a row that holds the bytes: the smallest) and how many rows had it. Wherever
a digest was hit more than once the full bytes are compared; should two texts
share a digest, its rows are grouped again by their text.

Defined cases: a null text equals an empty one. Rows of one group without any id
keep a null ``keep_id`` and are all kept. Rows that repeat an id and its text
count into ``group_size`` and are told apart by nothing, so each carries the
verdict of its id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylog.session import cut_lineage, new_shared_path

#: State on disk; without preallocated files, of which every state partition would hold several megabytes, and with one
#: limit on the native memory of all state partitions of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def run_state(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream the (digest, id) files of ``path`` through the keyed state and read the state back."""
    checkpoint = new_shared_path(spark, "dedup-state")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    kept = reader.parquet(path).groupBy("digest").agg(F.max("id").alias("keep_id"), F.min("id").alias("locator"), F.count("*").alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = kept.writeStream.outputMode("update").format("noop").trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
        stream.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        columns = state.schema["value"].dataType.names
        return state.select("key.digest", *[F.col(f"value.{c}").alias(n) for c, n in zip(columns, ("keep_id", "locator", "group_size"), strict=True)])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest``.

    ``digest`` maps a text column to the state's key; a weak one costs time, not exactness.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    narrow = new_shared_path(spark, "digests")
    schema = rows.select("id", "digest").schema
    rows.select("id", "digest").write.parquet(narrow)
    ids = spark.read.schema(schema).parquet(narrow)
    if ids.isEmpty():
        state = ids.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    else:
        state = run_state(spark, narrow, schema).drop("locator")

    # Full bytes of every digest that was hit again: equal texts have an equal least and greatest text.
    # Copies meet their own task's least and greatest before the shuffle, so a hot group sends two texts per task.
    spans = rows.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    clashing = cut_lineage(spans.where("least <> greatest").select("digest"))
    if clashing.isEmpty():
        found = ids.join(state, "digest")
    else:
        again = rows.join(clashing, "digest", "left_semi")
        groups = again.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        split = again.join(groups, ["digest", "text"]).select("digest", "id", "keep_id", "group_size")
        found = ids.join(clashing, "digest", "left_anti").join(state, "digest").unionByName(split)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per distinct text, that of the largest id."""
    keep = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("keep"), F.col("digest").alias("of")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), sha256(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("keep")) & (F.col("digest") == F.col("of"))
    left = rows.join(keep.hint("shuffle_hash"), same, "left_semi")
    return left.dropDuplicates(["id", "digest"]).select("row.*")
