from pyspark.sql import functions as F

import pytest
from quarrylog.operators import prompts, validation
from quarrylog.sources import files


def test_server_log(spark, tmp_path):
    """Statements on several lines, the word Query inside one, bytes that are no UTF-8."""
    log = (
        b"banner\n240828 10:00:00   1 Query\tSET NAMES utf8\n240828 10:00:01   1 Query\tSELECT a\nFROM t"
        b"\n240828 10:00:02   2 Query\tSELECT 'Query me' FROM u\n10:00:03   2 Query\tSELECT '\xff' FROM v"
        b"\n240828 10:00:04   2 Query\tcut off"
    )
    (tmp_path / "server.log").write_bytes(log)
    got = files.read_server_log(spark, str(tmp_path / "server.log")).orderBy("pos").collect()
    assert [r["sql"] for r in got] == ["SELECT a\nFROM t", "SELECT 'Query me' FROM u", "SELECT '' FROM v"]
    assert [r["pos"] for r in got] == [2, 3, 4]


def test_server_log_split_file(spark, tmp_path):
    """A file cut into many splits gives the same statements in the same order."""
    body = "".join(f"\n24 10:00   {i} Query\tSELECT {i} FROM t WHERE s = 'a Query b'" for i in range(400))
    (tmp_path / "big.log").write_text("x" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.read_server_log(spark, str(tmp_path / "big.log"), 1, 0).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["sql"] for r in got] == [f"SELECT {i} FROM t WHERE s = 'a Query b'" for i in range(400)]


def test_dump(spark, tmp_path):
    (tmp_path / "shop.sql").write_text(
        "-- dump\nDROP TABLE IF EXISTS `a`;\nCREATE TABLE `a` (\n  `id` int,\n  `x` int,\n  PRIMARY KEY (`id`)\n) ENGINE=InnoDB DEFAULT;\nINSERT INTO `a` VALUES (1);\n"
    )
    got = files.read_dump_columns(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("shop", "a", "id"), ("shop", "a", "x"), ("shop", "a", "id")]


def test_semicolon_schema(spark, tmp_path):
    (tmp_path / "T1.csv").write_text("NAME ; TYPE\n----- ; ----\nID ; INT\nAGE ; LONG\n")
    rows = files.read_semicolon_schema(spark, str(tmp_path)).orderBy("row", "col").collect()
    assert [(r["table_name"], r["column_name"], r["value"]) for r in rows] == [
        ("T1", "NAME", "ID"), ("T1", "TYPE", "INT"), ("T1", "NAME", "AGE"), ("T1", "TYPE", "LONG"),
    ]
    assert [r["table_name"] for r in files.table_names(spark, str(tmp_path)).collect()] == ["T1"]


def test_table_names_of_files_and_folders(spark, tmp_path):
    (tmp_path / "one.csv").write_text("x\n")
    spark.range(4).repartition(2).write.csv(str(tmp_path / "two.csv"))
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "three.csv").write_text("x\n")
    (tmp_path / "notes.txt").write_text("x\n")
    assert sorted(r["table_name"] for r in files.table_names(spark, str(tmp_path)).collect()) == ["one", "two"]


def test_folder_as_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    found = files.folder_as_tables(spark, str(tmp_path), ["a", "missing"])
    assert list(found) == ["a"] and spark.table("a").count() == 1


def test_json_and_catalog(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"question_id": 1, "db_id": "d", "sql": "SELECT 1"}, {"question_id": 2}]')
    assert files.read_log_json(spark, str(tmp_path / "q.json")).count() == 2
    (tmp_path / "tables.csv").write_text('schema\n"D-T,a,b"\n')
    assert tuple(files.read_catalog_csv(spark, str(tmp_path / "tables.csv")).first()) == ("D-T", ["a", "b"])


def test_schema_dialects(spark):
    arrays = spark.createDataFrame(
        [("d", ["t", "u"], [(-1, "*"), (0, "id"), (0, "x"), (1, "tid")], ["text", "int", "text", "int"], [1], [[3, 1]])],
        "db_id string, table_names_original array<string>, column_names_original array<struct<table_idx:int,name:string>>,"
        " column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>",
    )
    got = {r["column_name"]: (r["table_name"], r["pkey"], r["fkey"]) for r in files.schema_from_arrays(arrays).collect()}
    assert got == {"id": ("t", "PRIMARY KEY", ""), "x": ("t", "", ""), "tid": ("u", "", "FOREIGN KEY D-T (id)")}
    maps = spark.createDataFrame(
        [("d", "t", ["a", "b"], ["int", "int"], ["a"], [("b", "d#sql#u", "id")]), ("dw", "t", ["a"], ["int"], ["a"], [])],
        "db_id string, table_name_original string, column_names_original array<string>, column_types array<string>,"
        " primary_key array<string>, foreign_key array<struct<column_name:string,referenced_table_name:string,referenced_column_name:string>>",
    )
    rows = {(r["db_id"], r["column_name"]): (r["pkey"], r["fkey"]) for r in files.schema_from_maps(maps, "dw").collect()}
    assert rows == {("d", "a"): ("PRIMARY KEY", ""), ("d", "b"): ("", "FOREIGN KEY d-u (id)"), ("dw", "a"): ("", "")}


def test_ddl_text(spark):
    rows = [("d", "T", 0, "ID", "INT", "PRIMARY KEY", ""), ("d", "T", 1, "X", "TEXT", "", "FOREIGN KEY U (ID)")]
    columns = spark.createDataFrame(rows, "db_id string, table_name string, ordinal int, column_name string, data_type string, pkey string, fkey string")
    text = prompts.table_ddl(columns).first()["ddl"]
    assert text == "CREATE TABLE T(\n  ID INT,\n  X TEXT,\n  PRIMARY KEY (ID),\n  FOREIGN KEY(X) U (ID)\n)\n\n"


def test_validation(spark):
    records = spark.createDataFrame([("1", "SELECT 1", "q"), ("2", None, "q"), ("3", None, None)], "id string, sql string, question string")
    report = validation.roll_up(validation.record_violations(records, "id"), validation.missing_columns(records.select(F.col("id").alias("table"))))
    got = {(r["check"], r["problem"]): r["n_items"] for r in report.collect()}
    assert got == {("record", "sql"): 2, ("record", "question"): 1, ("schema", "missing column"): 3}


@pytest.mark.parametrize("name", ["r2_stream_templates", "r3_stream_sessions", "r4_stream_first_seen"])
def test_streams_read_folders_as_files(spark, sf, tmp_path, name):
    """A table that is a folder of part files streams like the single file."""
    import __spark_entry__

    for table in ("orders", "events"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(4).write.parquet(str(tmp_path / f"{table}.parquet"))
    run = __spark_entry__.queries()[name]
    expected, got = (sorted(map(repr, run(spark, folder).collect())) for folder in (sf, str(tmp_path)))
    assert got == expected and expected


def test_rejects_keep_all_errors(spark):
    records = spark.createDataFrame([("1", "SELECT 1", "q"), ("2", None, "q"), ("3", None, None)], "id string, sql string, question string")
    found = validation.split_valid(records, validation.record_errors())
    assert (found.n, found.n_rejected, found.passed) == (3, 2, False)
    assert [r["id"] for r in found.accepted.collect()] == ["1"] and found.accepted.columns == records.columns
    assert {r["id"]: r["errors"] for r in found.rejected.collect()} == {"2": ["no sql"], "3": ["no sql", "no question"]}
    nothing = validation.split_valid(records.limit(0), validation.record_errors())
    assert nothing.passed and nothing.n == 0 and nothing.rejected.count() == 0


def test_metric_log_of_two_writers(spark, tmp_path):
    """Writers at the same time lose nothing, and a batch that is written again replaces itself."""
    from concurrent.futures import ThreadPoolExecutor

    config = "db_id string, model string, eval_type string, k int, n_examples int, n_votes int, flags string, accuracy double, recall double, precision double, f1 double"
    row = lambda score: spark.createDataFrame([("d", "m", "t", 1, 1, 1, "NN", score, score, score, score)], config)
    path = str(tmp_path / "log")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda b: files.append_metrics(row(b / 10), path, f"b{b}"), range(8)))
    files.append_metrics(row(0.0), path, "b0")
    files.append_metrics(row(0.9), path, "b7")
    got = files.read_metrics(spark, path).orderBy("run").collect()
    assert [(r["run"], r["f1"]) for r in got] == [(i + 1, s / 10) for i, s in enumerate([0, 1, 2, 3, 4, 5, 6, 9])]
