"""Work per row and per task of the queries that grew past their limits."""

import time

import pandas as pd
from pyspark.sql import Row, functions as F

from quarrylog import inputs
from quarrylog.functions import sqltext, text
from quarrylog.operators import sampling, scoring, workload


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_task_of_text_work_has_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(inputs, "TASK_ROWS", 10, raising=False)
    rows = spark.range(0, 1000, 1, 9)
    dealt = inputs.spread(rows)
    assert dealt.rdd.getNumPartitions() == 100
    assert dealt.count() == 1000 and dealt.agg(F.sum("id")).first()[0] == 499500
    assert inputs.spread(dealt).rdd.getNumPartitions() == 100


def test_contractions_are_searched_where_an_apostrophe_is():
    long = "word and more " * 150_000 + "She Can't've, theY'LL and 'cause xi'd've"
    started = time.perf_counter()
    got = text._expanded.func(pd.Series([long, None, ""]))
    assert time.perf_counter() - started < 2
    assert got[0].endswith("more She Can not have, they will and because xi would have") and got[2] == ""


def test_stop_words_are_a_hash_set(spark):
    frame = spark.createDataFrame([Row(s="The cat\tAND  a\nDog")])
    short = frame.select(text.drop_stop_words(F.col("s")).alias("s"))
    assert short.first()[0] == "cat Dog"
    assert "array_contains" not in plan(short)


def test_a_short_number_is_formatted_once(spark):
    shown = spark.range(3).select(text.short_number(F.col("id") / 7).alias("x"))
    assert plan(shown).count("format_string(") == 1
    assert [r[0] for r in shown.collect()] == ["0", "0.143", "0.286"]


def test_tables_and_columns_share_one_cleaned_statement(spark):
    statement = "WITH q AS (SELECT a.x FROM s.t a) SELECT q.x, COUNT(*) AS n FROM q JOIN u USING (k) -- FROM z"
    frame = spark.createDataFrame([Row(s=statement), Row(s=None)])
    both = frame.select(sqltext.refs(F.col("s")).alias("r"), sqltext.table_refs(F.col("s")).alias("t"), sqltext.column_refs(F.col("s")).alias("c"))
    first, none = both.collect()
    assert first["r"]["tables"] == first["t"] == ["T", "U"] and first["r"]["columns"] == first["c"] == ["X", "K"]
    assert none["t"] is None and none["c"] is None
    for user in (frame.select(sqltext.generalise(F.col("s")).alias("x")), workload.profile(frame, F.col("s"))):
        assert plan(user).count("DISTINCT\\s+FROM") == 1


def test_null_rule_scores_meet_their_sets_once(spark):
    frame = spark.createDataFrame([Row(i=1, g=["A"], p=["A", "B"])])
    scores = scoring.set_scores_null_rule(frame, ["i"], F.col("g"), F.col("p"))
    ratios, counts = plan(scores).splitlines()[:2]
    assert "array_intersect(" not in ratios and "array_intersect(" in counts


def test_levels_are_counted_once_for_a_quota(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 80, "a").otherwise("b").alias("level"))
    quota = sampling.proportional_quota(rows, "level", 10)
    assert "Range (" not in plan(quota)
    assert {r["level"]: r["quota"] for r in quota.collect()} == {"a": 8, "b": 2}


def test_a_level_counts_only_what_decides(spark):
    levels = spark.createDataFrame([Row(s="SELECT a FROM t")]).select(sqltext.difficulty(F.col("s")).alias("l"))
    assert levels.first()[0] == "easy"
    assert "INTERSECT" not in plan(levels) and "partition by" not in plan(levels)
