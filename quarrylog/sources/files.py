"""Logs, schemas, dumps and catalogs as files."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, types as T, functions as F

from quarrylog.functions.sqltext import strip
from quarrylog.operators.joins import spread_join
from quarrylog.operators.sequence import ordered, runs, with_previous

LOG_SCHEMA = T.StructType(
    [
        T.StructField("question_id", T.LongType()),
        T.StructField("db_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("sql", T.StringType()),
        T.StructField("difficulty", T.StringType()),
    ]
)
# Fixed value: what stands between two statements of a server log.
LOG_HEADER = r"\n[0-9\s:]+\s+$"
LOG_WORD = "Query"


def read_log_json(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """Query log as JSON: one array per file, or one record per line."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_log_lines(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """S1 for large logs: one record per line, so files split."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Records, one per line; replaces what is there."""
    df.write.mode("overwrite").json(path)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted ``TABLE,col1,...`` cells as table and column list."""
    cells = spark.read.csv(path, header=True, quote='"', escape='"')
    parts = F.split("schema", ",")
    return cells.select(parts[0].alias("table_name"), F.slice(parts, 2, 1 << 30).alias("columns"))


def write_runs(df: DataFrame, path: str) -> None:
    """Prediction runs; a new run adds a partition and never replaces one."""
    df.write.mode("append").partitionBy("dataset", "model", "k", "n_examples", "run").parquet(path)


#: What a metric row was measured with; rows that agree in all of these are runs of one configuration.
RUN_CONFIG = ("db_id", "model", "eval_type", "k", "n_examples", "n_votes", "flags")
SCORE_COLUMNS = ("accuracy", "recall", "precision", "f1")


def append_metrics(rows: DataFrame, path: str, batch: str) -> None:
    """Metric rows (``RUN_CONFIG`` and ``SCORE_COLUMNS``) added to the run log.

    Every batch has a folder of its own, so writers need not wait for each other
    and lose nothing, and a batch that is written again replaces itself.
    """
    rows.select(*RUN_CONFIG, *SCORE_COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The run log with ``run``: the number of a row among those of its configuration, in the order of the batch names."""
    window = Window.partitionBy(*RUN_CONFIG).orderBy("batch", *SCORE_COLUMNS)
    rows = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("string"))
    return rows.withColumn("run", F.row_number().over(window))


def table_names(spark: SparkSession, path: str) -> DataFrame:
    """Table names of a schema folder, from its files ``name.csv`` or folders ``name.csv`` of part files."""
    # Only file metadata is read, not file content.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path).select("path")
    folder = re.escape(path.rstrip("/").rsplit("/", 1)[-1])
    name = F.regexp_extract("path", rf"/{folder}/([^/]+)\.csv(?:/part-[^/]+)?$", 1)
    return listed.select(name.alias("table_name")).where("table_name <> ''").distinct()


def read_semicolon_schema(spark: SparkSession, path: str) -> DataFrame:
    """Per file a header line, a rule line that goes, and cells; one row per cell.

    Files of different headers fit one frame this way. A schema file describes
    one table, so it is read as one text.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.csv)?$", 1).alias("table_name"), "value"
    )
    return schema_cells(files)


def schema_cells(texts: DataFrame) -> DataFrame:
    """Cells of ``(table_name, value)`` rows, ``value`` being a whole semicolon schema."""
    lines = texts.select("table_name", F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("lines"))
    rows = lines.select(
        "table_name", F.split(F.col("lines")[0], ";").alias("header"), F.posexplode(F.slice("lines", 3, 1 << 30)).alias("row", "line")
    )
    zipped = F.zip_with("header", F.split("line", ";"), lambda h, c: F.struct(F.trim(h).alias("h"), F.trim(c).alias("c")))
    cells = rows.select("table_name", "row", F.posexplode(zipped).alias("col", "cell"))
    return cells.select("table_name", "row", "col", F.col("cell.h").alias("column_name"), F.col("cell.c").alias("value"))


def read_server_log(spark: SparkSession, path: str, skip_first: int = 2, skip_last: int = 1) -> DataFrame:
    """Statements of a raw server log, in order, text that is not UTF-8 ignored.

    Records end at the word before a statement, so one huge file is still read
    in parallel; each record ends in the next statement's line header. A record
    without that header was cut at a "Query" inside a statement and is joined
    to what follows. Positions count pieces from the start of a file; its first
    pieces and the last are dropped.
    """
    raw = spark.read.option("lineSep", LOG_WORD).text(path)
    # Records are numbered in reading order: by file, by block, then within the task.
    placed = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "�", "").alias("piece"),
    )
    ends = F.concat(F.lit("\n"), F.col("piece")).rlike(LOG_HEADER)
    seq = ordered(placed.withColumn("ends", ends), ["file", "block", "at"])
    starts = F.col("_first") | F.coalesce("prev_ends", F.lit(True))
    numbered = runs(with_previous(seq, ["ends"], ["file"]), starts)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "piece"))), lambda p: p["piece"]), LOG_WORD)
    whole = numbered.groupBy("file", "run").agg(text.alias("text"))
    bounds = whole.groupBy("file").agg(F.min("run").alias("low"), F.max("run").alias("high"), F.count("*").alias("n"))
    kept = spread_join(whole, bounds, ["file"], ["run"], n="n").where((F.col("run") >= F.col("low") + skip_first) & (F.col("run") <= F.col("high") - skip_last))
    statement = strip(F.regexp_replace(F.concat(F.lit("\n"), F.col("text")), LOG_HEADER, ""))
    return kept.select("file", (F.col("run") - F.col("low")).alias("pos"), statement.alias("sql"))


def read_dump_columns(spark: SparkSession, path: str) -> DataFrame:
    """``(db_id, table_name, column_name)`` from SQL dumps, keys included as the back-quoted names they use.

    A dump is read statement by statement, so its size does not matter.
    """
    statements = spark.read.option("lineSep", ";\n").text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.sql)?$", 1).alias("db_id"), "value"
    )
    body = F.regexp_extract("value", r"(?s)CREATE TABLE (.*?) ENGINE=InnoDB", 1)
    tables = statements.select("db_id", body.alias("body")).where("body <> ''")
    names = F.regexp_extract_all("body", F.lit(r"`([^`]+)`"), F.lit(1))
    named = tables.select("db_id", names.alias("names"))
    return named.select("db_id", F.col("names")[0].alias("table_name"), F.explode(F.slice("names", 2, 1 << 30)).alias("column_name"))


def schema_from_arrays(schemas: DataFrame) -> DataFrame:
    """Benchmark schema JSON with parallel arrays to one row per column, keys resolved."""
    tables = schemas.select("db_id", F.posexplode("table_names_original").alias("table_idx", "table_name"))
    listed = schemas.select(
        "db_id", F.posexplode(F.arrays_zip("column_names_original", "column_types")).alias("col_idx", "c"), "primary_keys"
    ).select(
        "db_id",
        "col_idx",
        F.col("c.column_names_original.table_idx").alias("table_idx"),
        F.col("c.column_names_original.name").alias("column_name"),
        F.col("c.column_types").alias("data_type"),
        F.when(F.array_contains("primary_keys", F.col("col_idx")), "PRIMARY KEY").otherwise("").alias("pkey"),
    )
    columns = listed.join(tables, ["db_id", "table_idx"])
    links = schemas.select("db_id", F.explode("foreign_keys").alias("fk")).select(
        "db_id", F.col("fk")[0].alias("col_idx"), F.col("fk")[1].alias("ref_idx")
    )
    targets = columns.select(
        "db_id",
        F.col("col_idx").alias("ref_idx"),
        F.concat(
            F.lit("FOREIGN KEY "), F.upper("db_id"), F.lit("-"), F.upper("table_name"), F.lit(" ("), F.col("column_name"), F.lit(")")
        ).alias("fkey"),
    )
    # The last link of a column wins, as a later entry replaces an earlier one.
    resolved = links.join(targets, ["db_id", "ref_idx"]).groupBy("db_id", "col_idx").agg(F.max_by("fkey", "ref_idx").alias("fkey"))
    return columns.join(resolved, ["db_id", "col_idx"], "left").select(
        "db_id", "table_name", F.col("col_idx").alias("ordinal"), "column_name", "data_type", "pkey", F.coalesce("fkey", F.lit("")).alias("fkey")
    )


def schema_from_maps(tables: DataFrame, keyless_db: str | None = None) -> DataFrame:
    """Second schema JSON dialect, one struct per table, referenced names split on ``#``."""
    columns = tables.select(
        "db_id",
        F.col("table_name_original").alias("table_name"),
        F.posexplode(F.arrays_zip("column_names_original", "column_types")).alias("ordinal", "c"),
        "primary_key",
        F.transform(
            "foreign_key",
            lambda k: F.struct(
                k["column_name"].alias("column_name"),
                F.concat(
                    F.lit("FOREIGN KEY "), F.split(k["referenced_table_name"], "#")[0], F.lit("-"),
                    F.split(k["referenced_table_name"], "#")[2], F.lit(" ("), k["referenced_column_name"], F.lit(")"),
                ).alias("fkey"),
            ),
        ).cast("array<struct<column_name:string,fkey:string>>").alias("links"),
    )
    name = F.col("c.column_names_original")
    has_keys = F.lit(True) if keyless_db is None else F.col("db_id") != keyless_db
    # The last entry of a column wins, as a later key replaces an earlier one.
    link = F.try_element_at(F.filter("links", lambda k: k["column_name"] == name), F.lit(-1))["fkey"]
    return columns.select(
        "db_id",
        "table_name",
        "ordinal",
        name.alias("column_name"),
        F.col("c.column_types").alias("data_type"),
        F.when(has_keys & F.array_contains("primary_key", name), "PRIMARY KEY").otherwise("").alias("pkey"),
        F.when(has_keys, F.coalesce(link, F.lit(""))).otherwise("").alias("fkey"),
    )


def folder_as_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Each CSV file of a folder as a temp view named after it; unreadable files are left out."""
    found = {}
    for name in names:
        try:
            frame = spark.read.csv(f"{path}/{name}.csv", header=True)
            frame.createOrReplaceTempView(name)
            found[name] = frame
        except AnalysisException:  # a missing or empty file must not stop the others
            continue
    return found
