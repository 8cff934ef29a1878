"""Files written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.functions import sqltext
from quarrylog.inputs import QUERY_LOG_SQL, SCHEMA_COLUMNS_SQL, label_pairs, query_log, runs, schema_columns, table
from quarrylog.inputs import LABEL_PAIRS_SQL, RUNS_SQL
from quarrylog.operators import prompts, scoring
from quarrylog.plans.scoring import SCORES, gold_tables, pred_tables
from quarrylog.registry import query
from quarrylog.session import cut_lineage, new_shared_path
from quarrylog.sources import files

_SCHEMA = o.with_(schema_columns=SCHEMA_COLUMNS_SQL)


@query("s1_json_log", o.QL + "SELECT query_id AS question_id, db_id, gold_sql AS sql FROM query_log")
def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log written as JSON records and read with a fixed schema."""
    path = new_shared_path(spark, "log")
    log = query_log(spark, sf_dir)
    files.write_json(log.select(F.col("query_id").alias("question_id"), "db_id", F.col("gold_sql").alias("sql")), path)
    return files.read_log_lines(spark, path).select("question_id", "db_id", "sql")


@query("s3_dataset_export", o.with_(query_log=QUERY_LOG_SQL) + "SELECT concat('Describe ', gold_sql) AS question, gold_sql AS sql, db_id FROM query_log WHERE gold_sql <> 'COMMIT'")
def dataset_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "export")
    kept = query_log(spark, sf_dir).where(sqltext.is_statement(F.col("gold_sql")))
    files.write_json(kept.select(F.concat(F.lit("Describe "), F.col("gold_sql")).alias("question"), F.col("gold_sql").alias("sql"), "db_id"), path)
    return files.read_log_lines(spark, path).select("question", "sql", "db_id")


@query("s4_catalog_csv", _SCHEMA + "SELECT concat(upper(db_id), '-', table_name) AS table_name, string_agg(column_name, ';' ORDER BY ordinal) AS columns FROM schema_columns GROUP BY db_id, table_name")
def catalog_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "catalog")
    prompts.flat_catalog(schema_columns(spark, sf_dir)).select("schema").write.csv(path, header=True, quoteAll=True)
    return files.read_catalog_csv(spark, path).select("table_name", F.array_join("columns", ";").alias("columns"))


@query("s5_prediction_runs", o.with_(runs=RUNS_SQL) + "SELECT run % 3 AS run, count(*) AS n FROM runs GROUP BY ALL")
def prediction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends; the read is pruned to partition columns."""
    path = new_shared_path(spark, "runs")
    rows = runs(spark, sf_dir).select(
        "question_id", "prediction", F.lit("events").alias("dataset"), F.lit("none").alias("model"), F.lit(10).alias("k"),
        F.lit(1).alias("n_examples"), (F.col("run") % 3).alias("run"),
    )
    files.write_runs(rows.where("run = 0"), path)
    files.write_runs(rows.where("run > 0"), path)
    back = spark.read.parquet(path).where("dataset = 'events' AND k = 10")
    return back.groupBy(F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"))


@query("s7_label_parquet", o.with_(label_pairs=LABEL_PAIRS_SQL) + "SELECT doc_id, label, pred FROM label_pairs")
def label_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, S7."""
    path = new_shared_path(spark, "labels")
    label_pairs(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path).select("doc_id", "label", "pred")


@query("s8_table_names", "SELECT DISTINCT concat('source=', source) AS table_name FROM documents")
def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV folder per source; its name is found from file paths alone."""
    path = new_shared_path(spark, "tables")
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".csv")).alias("source"))
    named.write.partitionBy("source").csv(path)
    return files.table_names(spark, path)


@query("s9_semicolon_schema", _SCHEMA + """SELECT 'COLUMN_NAME' AS column_name, column_name AS value FROM schema_columns
  UNION ALL SELECT 'DATA_TYPE', data_type FROM schema_columns""")
def semicolon_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file per database, cells padded, read back cell by cell."""
    path = new_shared_path(spark, "semicolon")
    line = F.concat(F.col("column_name"), F.lit(" ; "), F.col("data_type"))
    grouped = schema_columns(spark, sf_dir).groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines")
    )
    head = F.array(F.lit("COLUMN_NAME ; DATA_TYPE"), F.lit("----------- ; ---------"))
    texts = grouped.select("table_name", F.array_join(F.concat(head, F.col("lines.line")), "\n").alias("value"))
    # Every record of the file is one schema text; a NUL parts them.
    texts.select("value").write.option("lineSep", "\x00").text(path)
    stored = spark.read.option("lineSep", "\x00").text(path)
    return files.schema_cells(stored.select(F.lit("").alias("table_name"), "value")).select("column_name", "value")


@query("s10_server_log", o.QL + "SELECT gold_sql AS sql, count(*) AS n FROM query_log GROUP BY gold_sql")
def server_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a server writes it, statements on several lines, then read and counted.

    Every piece is kept: the files hold no server banner and no cut-off end.
    """
    path = new_shared_path(spark, "server")
    text = F.concat(
        F.lit("240828 12:00:00   "), F.col("query_id"), F.lit(" Query\t"), F.regexp_replace("gold_sql", " FROM ", "\n FROM ")
    )
    query_log(spark, sf_dir).select(text.alias("value")).write.text(path)
    pieces = files.read_server_log(spark, path, skip_first=0, skip_last=0).where("sql <> ''")
    return pieces.select(F.regexp_replace("sql", "\n FROM ", " FROM ").alias("sql")).groupBy("sql").agg(F.count("*").alias("n"))


@query("s11_dump_columns", _SCHEMA + "SELECT db_id, table_name, column_name FROM schema_columns")
def dump_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "dump")
    cols = F.array_sort(F.collect_list(F.struct("ordinal", "column_name")))
    tables = schema_columns(spark, sf_dir).groupBy("db_id", "table_name").agg(cols.alias("c"))
    lines = F.array_join(F.transform("c", lambda c: F.concat(F.lit("  `"), c["column_name"], F.lit("` int"))), ",\n")
    ddl = F.concat(F.lit("CREATE TABLE `"), F.col("db_id"), F.lit("."), F.col("table_name"), F.lit("` (\n"), lines, F.lit("\n) ENGINE=InnoDB"))
    tables.select(ddl.alias("value")).write.option("lineSep", ";\n").text(path)
    found = files.read_dump_columns(spark, path)
    parts = F.split("table_name", "[.]")
    return found.select(parts[0].alias("db_id"), parts[1].alias("table_name"), "column_name")


@query("s12_folder_tables", "SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def folder_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of CSV tables read as one view each; the name without a file is left out."""
    path = new_shared_path(spark, "folder")
    names = ["customer", "supplier", "part"]
    for name in names:
        table(spark, sf_dir, name).write.csv(f"{path}/{name}.csv", header=True)
    found = files.folder_as_tables(spark, path, [*names, "absent"])
    sizes = [frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, frame in found.items()]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query("s13_metric_log", SCORES + """SELECT db_id, 'none' AS model, 'TABLE_NAME_EXTRACTION' AS eval_type, 10 AS k, 1 AS n_examples, 1 AS n_votes, 'NN' AS flags, run,
  round(avg(CASE WHEN acc THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(r), 6) AS recall, round(avg(p), 6) AS precision, round(avg(f), 6) AS f1
  FROM scores JOIN (VALUES (1), (2)) AS runs(run) ON true GROUP BY db_id, run""")
def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one configuration per database; the first is written twice and replaces itself."""
    path = new_shared_path(spark, "metrics")
    scores = scoring.set_scores(query_log(spark, sf_dir), ["query_id", "db_id"], gold_tables(), pred_tables())
    means = scores.groupBy("db_id").agg(
        F.avg(F.col("accuracy").cast("double")).alias("accuracy"), *[F.avg(c).alias(c) for c in ("recall", "precision", "f1")]
    )
    config = {"model": "none", "eval_type": "TABLE_NAME_EXTRACTION", "k": 10, "n_examples": 1, "n_votes": 1, "flags": "NN"}
    rows = cut_lineage(means.withColumns({name: F.lit(value) for name, value in config.items()}))
    for batch in ("first", "first", "second"):
        files.append_metrics(rows, path, batch)
    log = files.read_metrics(spark, path).drop("batch")
    return log.select(*files.RUN_CONFIG, "run", *[F.round(c, 6).alias(c) for c in files.SCORE_COLUMNS])


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schema record per table, as benchmark files hold one per database."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type")))
    grouped = schema_columns(spark, sf_dir).groupBy(F.col("table_name").alias("db_id")).agg(ordered.alias("c"))
    return grouped.select(
        "db_id",
        F.array(F.lit("main")).alias("table_names_original"),
        F.transform("c", lambda c: F.struct(F.lit(0).alias("table_idx"), c["column_name"].alias("name"))).alias("column_names_original"),
        F.col("c.data_type").alias("column_types"),
        F.array(F.lit(1)).alias("primary_keys"),
        F.when(F.size("c") > 4, F.array(F.array(F.lit(4), F.lit(1)))).otherwise(F.array()).alias("foreign_keys"),
    )


@query("j4_schema_arrays", _SCHEMA + """, n AS (SELECT table_name, column_name, data_type, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY table_name) AS size FROM schema_columns)
SELECT n.table_name AS db_id, n.column_name, CASE WHEN i = 1 THEN 'PRIMARY KEY' ELSE '' END AS pkey,
  CASE WHEN i = 4 THEN concat('FOREIGN KEY ', n.table_name, '-MAIN (', (SELECT m.column_name FROM n m WHERE m.table_name = n.table_name AND m.i = 1), ')') ELSE '' END AS fkey FROM n""")
def schema_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.schema_from_arrays(_arrays(spark, sf_dir)).select("db_id", "column_name", "pkey", "fkey")


@query("j5_schema_maps", _SCHEMA + """SELECT db_id, table_name, column_name, pkey,
  CASE WHEN fkey = '' THEN '' ELSE concat('FOREIGN KEY ', db_id, '-', regexp_extract(fkey, 'KEY (T[0-9]+)', 1), ' (ID)') END AS fkey FROM schema_columns""")
def schema_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.concat(F.col("db_id"), F.lit("#sql#"), F.regexp_extract("fkey", r"KEY (T[0-9]+)", 1))
    link = F.struct("column_name", target.alias("referenced_table_name"), F.lit("ID").alias("referenced_column_name"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type")))
    tables = schema_columns(spark, sf_dir).groupBy("db_id", F.col("table_name").alias("table_name_original")).agg(
        ordered.alias("c"),
        F.collect_list(F.when(F.col("pkey") != "", F.col("column_name"))).alias("primary_key"),
        F.collect_list(F.when(F.col("fkey") != "", link)).alias("foreign_key"),
    )
    shaped = tables.withColumns({"column_names_original": F.col("c.column_name"), "column_types": F.col("c.data_type")})
    return files.schema_from_maps(shaped).select("db_id", "table_name", "column_name", "pkey", "fkey")
