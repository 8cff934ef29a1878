"""Checks on uploaded logs and schemas; violations are rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from quarrylog.functions.vocab import REQUIRED_SCHEMA_COLUMNS
from quarrylog.session import new_shared_path


def ingest(records: DataFrame) -> DataFrame:
    """Gold columns renamed, working columns blank, ``db_id`` never null."""
    db = F.coalesce("db_id", F.lit("")) if "db_id" in records.columns else F.lit("")
    renamed = records.withColumnsRenamed({"sql": "gold_sql", "question": "gold_question"})
    blanks = {c: F.lit("") for c in ("sql", "question", "comment")}
    return renamed.withColumns({**blanks, "adjusted": F.lit(False), "options": F.array().cast("array<string>"), "db_id": db})


@dataclass(frozen=True)
class Checked:
    """What passed, what did not (with all its ``errors``), and how many rows there were of both."""

    accepted: DataFrame
    rejected: DataFrame
    n: int
    n_rejected: int

    @property
    def passed(self) -> bool:
        return self.n_rejected == 0


def split_valid(records: DataFrame, errors: Column) -> Checked:
    """Reads ``records`` once: rows without ``errors`` (an array of texts) and rejects go to a partition each, counted on the way."""
    seen = Observation()
    flagged = records.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    path = new_shared_path(records.sparkSession, "checked")
    counted = flagged.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("n_rejected"))
    counted.write.partitionBy("valid").parquet(path)
    stored = records.sparkSession.read.schema(flagged.schema).parquet(path)
    return Checked(stored.where("valid").drop("valid", "errors"), stored.where("NOT valid").drop("valid"), **seen.get)


def record_errors() -> Column:
    """What a record lacks, as texts."""
    return F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in ("sql", "question")]), lambda e: e.isNotNull()
    )


def record_violations(records: DataFrame, key: str) -> DataFrame:
    """Records without SQL or question."""
    missing = F.concat(
        F.when(F.col("sql").isNull(), F.array(F.lit("sql"))).otherwise(F.array()),
        F.when(F.col("question").isNull(), F.array(F.lit("question"))).otherwise(F.array()),
    )
    return records.select(F.col(key).cast("string").alias("item"), F.explode(missing).alias("problem")).withColumn("check", F.lit("record"))


def missing_columns(df: DataFrame) -> DataFrame:
    """Required schema columns the file lacks, one row each."""
    absent = [c for c in REQUIRED_SCHEMA_COLUMNS if c not in df.columns]
    spark = df.sparkSession
    return spark.createDataFrame([(c, "missing column", "schema") for c in absent], "item string, problem string, check string")


def roll_up(*violations: DataFrame) -> DataFrame:
    """One row per check and problem that failed, with the number of items and the first of them."""
    every = violations[0]
    for more in violations[1:]:
        every = every.unionByName(more)
    return every.groupBy("check", "problem").agg(F.count("*").alias("n_items"), F.min("item").alias("first_item"))
