"""Counts, averages and profiles over a query log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.functions import sqltext, vocab
from quarrylog.functions.text import ngrams, significant
from quarrylog.operators.compute import once


def category_totals(log: DataFrame, sql: Column, patterns: dict[str, str]) -> DataFrame:
    """Per category the total of matches and the largest count of one statement, in one pass."""
    counts = sqltext.category_counts(sql, patterns)
    counted = log.select(*[c.alias(n) for n, c in counts.items()])
    sums = counted.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(f"{n}_sum") for n in patterns],
        *[F.coalesce(F.max(n), F.lit(0)).alias(f"{n}_max") for n in patterns],
    )
    pairs = [
        F.struct(F.lit(n).alias("category"), F.col(f"{n}_sum").alias("total"), F.col(f"{n}_max").alias("largest"))
        for n in patterns
    ]
    return sums.select(F.inline(F.array(*pairs)))


def keyword_coverage(log: DataFrame, sql: Column, whole_words: bool = False) -> DataFrame:
    """A3: how many SQL keywords occur anywhere in the log; by substring unless ``whole_words``."""
    text = sql

    def seen(word: str) -> Column:
        return text.rlike(rf"\b{word}\b") if whole_words else text.contains(word)

    flags = log.agg(*[F.max(seen(w).cast("int")).alias(f"k{i}") for i, w in enumerate(vocab.SQL_KEYWORDS)])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"k{i}"), F.lit(0)) for i in range(len(vocab.SQL_KEYWORDS))])
    return flags.select(total.cast("long").alias("keywords_used"), F.lit(len(vocab.SQL_KEYWORDS)).alias("keywords_known"))


def category_breakdown(log: DataFrame, sql: Column, cluster: Column, patterns: dict[str, str]) -> DataFrame:
    """Statements per category, over all clusters and per cluster."""
    flags = sqltext.category_flags(sql, patterns)
    per_cluster = (
        log.select(cluster.alias("cluster"), *[f.cast("long").alias(n) for n, f in flags.items()])
        .groupBy("cluster")
        .agg(*[F.sum(n).alias(n) for n in patterns])
    )
    long = per_cluster.select(
        "cluster", F.inline(F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in patterns]))
    ).where("n > 0")
    return long.groupingSets(
        [("category",), ("category", "cluster")], "category", "cluster"
    ).agg(F.sum("n").alias("n_queries"))


def distinct_ngrams(log: DataFrame, sql: Column, n: int = 3) -> DataFrame:
    """A5: distinct n-grams per statement and the largest n-gram."""
    # The null gram of every statement counts the statements in the same shuffle.
    marked = F.concat(ngrams(sqltext.tokens(sql), n), F.array(F.lit(None).cast("string")))
    grams = log.select(F.explode(marked).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    found = grams.agg(
        F.count("gram").alias("distinct_ngrams"),
        F.max(F.when(F.col("gram").isNull(), F.col("n"))).alias("n_queries"),
        F.max("gram").alias("largest_ngram"),
    )
    return found.withColumn("per_query", F.col("distinct_ngrams") / F.col("n_queries"))


def profile(log: DataFrame, sql: Column) -> DataFrame:
    """Q4: averages of one workload, one scan."""
    counts = sqltext.category_counts(sql, vocab.OCCURRENCE_PATTERNS)
    row = log.select(
        *[c.alias(n) for n, c in counts.items()],
        F.regexp_count(sql, F.lit(" OVER ")).cast("long").alias("over_words"),
        sqltext.let(sqltext.tokens(sql), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.size(F.array_distinct(ngrams(t, 3))).cast("long").alias("grams"))).alias("t"),
        sqltext.let(sqltext.refs(sql), lambda r: F.struct(F.size(r["tables"]).cast("long").alias("tables"), F.size(r["columns"]).cast("long").alias("columns"))).alias("r"),
    )
    every = reduce(lambda a, b: a + b, [F.col(n) for n in counts])
    aggregate = reduce(lambda a, b: a + b, [F.col(n) for n in vocab.AGGREGATE_CATEGORIES])
    row = row.select("*", F.col("t.n").alias("tokens"), F.col("t.grams").alias("trigrams"), "r.tables", "r.columns").drop("t", "r")
    return row.agg(
        F.count("*").alias("n_queries"),
        F.avg("trigrams").alias("avg_trigrams"),
        (F.sum(every) / F.count("*")).alias("avg_keywords"),
        F.avg("tokens").alias("avg_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.avg("tables").alias("avg_tables"),
        F.max("tables").alias("max_tables"),
        F.avg("columns").alias("avg_columns"),
        F.max("columns").alias("max_columns"),
        F.sum("selection").alias("total_nesting"),
        F.sum(aggregate).alias("total_aggregates"),
        F.avg("over_words").alias("avg_windows"),
    )


def structure_averages(log: DataFrame, sql: Column) -> DataFrame:
    """A9 over P15 rows: statements with an aggregate or with two levels."""
    names = ["num_joins", "implicit_joins", "nesting", "aggregates", "textual_aggregates"]
    parts = once(log, parts=sqltext.structure(sql))
    # A statement without SELECT does not parse as a query.
    rows = parts.select(*[f"parts.{n}" for n in names], (F.col("parts.selects") > 0).alias("parsed"))
    kept = F.col("parsed") & ((F.col("aggregates") >= 1) | (F.col("nesting") >= 2))
    return rows.agg(
        F.count_if(kept).alias("n_complex"),
        F.count_if(~F.col("parsed")).alias("n_failed"),
        *[significant(F.avg(F.when(kept, F.col(n)))).alias(f"avg_{n}") for n in names[:-1]],
        F.avg(F.when(kept, F.col("textual_aggregates"))).alias("avg_textual_aggregates"),
    )


def catalog_statistics(columns: DataFrame) -> DataFrame:
    """Databases, tables per database, columns per table, 3 significant figures."""
    tables = columns.groupBy("db_id", "table_name").agg(F.count("*").alias("n_columns"))
    per_db = tables.groupBy("db_id").agg(F.count("*").alias("n_tables"), F.sum("n_columns").alias("n_columns"))
    return per_db.agg(
        F.count("*").alias("n_dbs"),
        significant(F.sum("n_tables") / F.count("*")).alias("tables_per_db"),
        significant(F.sum("n_columns") / F.sum("n_tables")).alias("columns_per_table"),
    )


def write_words(sql: Column, case_sensitive: bool = True) -> list[Column]:
    """Statements that hold each of the words a read-only workload must not hold."""
    held = sql if case_sensitive else F.upper(sql)
    return [F.count_if(held.contains(w)).alias(w.lower().replace(" ", "_")) for w in vocab.WRITE_WORDS]
