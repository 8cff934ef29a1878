"""Profiles of a query log: categories, tokens, tables, structure, difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.functions import sqltext, vocab
from quarrylog.inputs import QUERY_LOG_SQL, SCHEMA_COLUMNS_SQL, query_log, schema_columns, table
from quarrylog.operators import workload as ops
from quarrylog.operators.compute import once
from quarrylog.registry import query


def gold() -> Column:
    return F.col("gold_sql")


REFS = o.with_(query_log=QUERY_LOG_SQL, **o.refs("query_log", "gold_sql"))


def _totals_oracle(patterns: dict[str, str]) -> str:
    unions = " UNION ALL ".join(
        f"SELECT {o.quoted(n)} AS category, CAST(coalesce(sum({x}), 0) AS BIGINT) AS total, max({x}) AS largest FROM query_log"
        for n, x in ((n, o.occurrences("gold_sql", n, p)) for n, p in patterns.items())
    )
    return o.QL + unions


@query("a1_category_totals", _totals_oracle(vocab.OCCURRENCE_PATTERNS))
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.category_totals(query_log(spark, sf_dir), gold(), vocab.OCCURRENCE_PATTERNS)


@query("a16_log_category_totals", _totals_oracle(vocab.LOG_PATTERNS))
def log_category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.category_totals(query_log(spark, sf_dir), gold(), vocab.LOG_PATTERNS)


@query("a2_aggregate_total", o.QL + "SELECT CAST(sum(" + " + ".join(
    o.occurrences("gold_sql", n, vocab.OCCURRENCE_PATTERNS[n]) for n in vocab.AGGREGATE_CATEGORIES
) + ") AS BIGINT) AS total FROM query_log")
def aggregate_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = {n: vocab.OCCURRENCE_PATTERNS[n] for n in vocab.AGGREGATE_CATEGORIES}
    return ops.category_totals(query_log(spark, sf_dir), gold(), chosen).agg(F.sum("total").alias("total"))


@query("f6_category_counts", o.QL + "SELECT query_id, " + ", ".join(
    f"{o.occurrences('gold_sql', n, p)} AS {n}" for n, p in vocab.OCCURRENCE_PATTERNS.items()
) + " FROM query_log")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sqltext.category_counts(gold(), vocab.OCCURRENCE_PATTERNS)
    return query_log(spark, sf_dir).select("query_id", *[c.alias(n) for n, c in counts.items()])


@query("a3_keyword_coverage", o.QL + "SELECT CAST(" + " + ".join(
    f"max(CASE WHEN contains(gold_sql, {o.quoted(w)}) THEN 1 ELSE 0 END)" for w in vocab.SQL_KEYWORDS
) + f" AS BIGINT) AS keywords_used, {len(vocab.SQL_KEYWORDS)} AS keywords_known FROM query_log")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyword_coverage(query_log(spark, sf_dir), gold())


@query("a4_token_counts", o.QL + f"""SELECT round(avg(n), 6) AS avg_tokens, max(n) AS max_tokens
  FROM (SELECT CAST(len({o.tokens('gold_sql')}) AS BIGINT) AS n FROM query_log) AS t""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = query_log(spark, sf_dir).select(F.size(sqltext.tokens(gold())).cast("long").alias("n"))
    return sizes.agg(F.round(F.avg("n"), 6).alias("avg_tokens"), F.max("n").alias("max_tokens"))


@query("a5_distinct_ngrams", o.QL + f""", toks AS (SELECT {o.tokens('gold_sql')} AS t FROM query_log),
grams AS (SELECT DISTINCT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS gram
  FROM toks WHERE len(t) >= 3)
SELECT count(*) AS distinct_ngrams, (SELECT count(*) FROM toks) AS n_queries,
  count(*) / (SELECT count(*) FROM toks) AS per_query, max(gram) AS largest_ngram FROM grams""")
def distinct_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_ngrams(query_log(spark, sf_dir), gold())


@query("f3_table_refs", REFS + "SELECT query_id, array_to_string(tabs, ',') AS tables FROM refs")
def table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select("query_id", F.array_join(sqltext.table_refs(gold()), ",").alias("tables"))


@query("f4_column_refs", REFS + "SELECT query_id, array_to_string(list_sort(cols), ',') AS columns FROM refs")
def column_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select(
        "query_id", F.array_join(F.array_sort(sqltext.column_refs(gold())), ",").alias("columns")
    )


@query("a6_tables_per_query", REFS + """SELECT round(avg(len(tabs)), 6) AS avg_tables, CAST(max(len(tabs)) AS INTEGER) AS max_tables
  FROM refs""")
def tables_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = query_log(spark, sf_dir).select(F.size(sqltext.table_refs(gold())).alias("n"))
    return sizes.agg(F.round(F.avg("n"), 6).alias("avg_tables"), F.max("n").alias("max_tables"))


@query("a7_columns_per_query", REFS + """SELECT round(avg(n), 6) AS avg_columns, max(n) AS max_columns,
  count(*) - count(n) AS n_failed
  FROM (SELECT CASE WHEN regexp_matches(gold_sql, '(?i)\\bSELECT\\b') THEN CAST(len(cols) AS INTEGER) END AS n FROM refs) AS t""")
def columns_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.when(sqltext.select_count(gold()) > 0, F.size(sqltext.column_refs(gold())))
    sizes = query_log(spark, sf_dir).select(parsed.alias("n"))
    return sizes.agg(
        F.round(F.avg("n"), 6).alias("avg_columns"),
        F.max("n").alias("max_columns"),
        F.count_if(F.col("n").isNull()).alias("n_failed"),
    )


@query("a8_catalog_statistics", o.with_(schema_columns=SCHEMA_COLUMNS_SQL) + """,
 tabs AS (SELECT db_id, table_name, count(*) AS n FROM schema_columns GROUP BY ALL),
 dbs AS (SELECT db_id, count(*) AS t, sum(n) AS c FROM tabs GROUP BY ALL)
SELECT count(*) AS n_dbs, CAST(printf('%.2e', CAST(sum(t) AS DOUBLE) / count(*)) AS DOUBLE) AS tables_per_db,
  CAST(printf('%.2e', CAST(sum(c) AS DOUBLE) / CAST(sum(t) AS DOUBLE)) AS DOUBLE) AS columns_per_table FROM dbs""")
def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.catalog_statistics(schema_columns(spark, sf_dir))


_TEXT = o.replaced("gold_sql", o.LITERAL, "''")


def _h(pattern: str) -> str:
    return o.hits(_TEXT, "(?i)" + pattern)


STRUCTURE = f"""{_h(r'\bJOIN\b')} AS num_joins,
  {_h(r'<=|>=|<>|!=|=|<|>|\bLIKE\b|\bIN\b|\bBETWEEN\b')} AS num_conditions,
  {_h(r'\bGROUP\s+BY\b')} > 0 AS has_group_by, {_h(r'\bORDER\s+BY\b')} > 0 AS has_order_by,
  {_h(r'\bHAVING\b')} > 0 AS has_having, {_h(r'[(]\s*SELECT\b')} > {_h(r'\bAS\s*[(]\s*SELECT\b')} AS has_subquery,
  {_h(r'\bSELECT\b')} - {_h(r'\b(?:INTERSECT|EXCEPT)\b')} AS nesting,
  CAST(len({o.found(_TEXT, r'(?i)\b(?:WHERE|AND)\s+([a-z_]\w*\.\w+\s*=\s*[a-z_]\w*\.\w+)', 1)}) AS BIGINT) AS implicit_joins,
  {_h(r'\b(?:SUM|AVG|MIN|MAX|COUNT)\s*[(]|\bGROUP\s+BY\b')} AS aggregates,
  {_h(r'(?:sum|avg|min|max|count) ?[(]|group by|partition by')} AS textual_aggregates"""
PARTS = o.with_(query_log=QUERY_LOG_SQL, parts=f"SELECT *, {STRUCTURE} FROM query_log")
LEVEL = """CASE WHEN has_subquery THEN 'extra' WHEN num_joins >= 2 OR has_group_by THEN 'hard'
  WHEN num_joins = 1 OR num_conditions > 2 THEN 'medium' ELSE 'easy' END"""


@query("q1_structure", PARTS + """SELECT query_id, num_joins, num_conditions, has_group_by, has_order_by, has_having,
  has_subquery FROM parts""")
def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["num_joins", "num_conditions", "has_group_by", "has_order_by", "has_having", "has_subquery"]
    parts = once(query_log(spark, sf_dir).select("query_id", "gold_sql"), parts=sqltext.structure(gold()))
    return parts.select("query_id", *[f"parts.{n}" for n in names])


@query("q2_difficulty", PARTS + f"SELECT query_id, {LEVEL} AS level FROM parts")
def difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select("query_id", sqltext.difficulty(gold()).alias("level"))


@query("a26_difficulty_counts", PARTS + f"""SELECT CASE WHEN nesting < 1 THEN 'failed' ELSE {LEVEL} END AS level,
  count(*) AS n_queries FROM parts GROUP BY 1""")
def difficulty_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(sqltext.select_count(gold()) < 1, "failed").otherwise(sqltext.difficulty(gold()))
    return query_log(spark, sf_dir).select(level.alias("level")).groupBy("level").agg(F.count("*").alias("n_queries"))


def _sig(expr: str) -> str:
    return f"CAST(printf('%.2e', CAST({expr} AS DOUBLE)) AS DOUBLE)"


@query("a9_structure_averages", PARTS + f"""SELECT count(*) FILTER (kept) AS n_complex,
  count(*) FILTER (nesting < 1) AS n_failed, {_sig('avg(num_joins) FILTER (kept)')} AS avg_num_joins,
  {_sig('avg(implicit_joins) FILTER (kept)')} AS avg_implicit_joins, {_sig('avg(nesting) FILTER (kept)')} AS avg_nesting,
  {_sig('avg(aggregates) FILTER (kept)')} AS avg_aggregates,
  avg(textual_aggregates) FILTER (kept) AS avg_textual_aggregates
  FROM (SELECT *, nesting >= 1 AND (aggregates >= 1 OR nesting >= 2) AS kept FROM parts) AS k""")
def structure_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.structure_averages(query_log(spark, sf_dir), gold())


@query("p15_complex_queries", PARTS + "SELECT query_id FROM parts WHERE nesting >= 1 AND (aggregates >= 1 OR nesting >= 2)")
def complex_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = once(query_log(spark, sf_dir).select("query_id", "gold_sql"), parts=sqltext.structure(gold()))
    return parts.where("parts.selects > 0 AND (parts.aggregates >= 1 OR parts.nesting >= 2)").select("query_id")


@query("p14_nested_queries", o.QL + f"SELECT query_id FROM query_log WHERE {o.hits('gold_sql', '(?i)' + chr(92) + 'bSELECT' + chr(92) + 'b')} >= 2")
def nested_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).where(sqltext.is_nested(gold())).select("query_id")


STATEMENT = """NOT starts_with(gold_sql, 'COMMIT') AND NOT starts_with(gold_sql, 'ROLLBACK')
  AND NOT starts_with(gold_sql, 'SET') AND NOT starts_with(gold_sql, 'SELECT 1') AND NOT contains(gold_sql, 'SAVEPOINT')"""


@query("p5_statements", o.QL + f"SELECT query_id, gold_sql FROM query_log WHERE {STATEMENT}")
def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).where(sqltext.is_statement(gold())).select("query_id", "gold_sql")


@query("p6_read_only_audit", o.QL + "SELECT " + ", ".join(
    f"count(*) FILTER (contains(gold_sql, {o.quoted(w)})) AS {w.lower().replace(' ', '_')}" for w in vocab.WRITE_WORDS
) + " FROM query_log")
def read_only_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).agg(*ops.write_words(gold()))


_WRITES = {
    "purchase": "insert into events values (%s)",
    "error": "DELETE FROM events WHERE event_id = %s",
    "click": "update events set value = 0 where event_id = %s",
    "signup": "CREATE INDEX by_user_%s ON events (user_id)",
    "view": "alter table events add primary key (event_id) -- EXEC %s",
}
_WRITES_SQL = "CASE event_type " + " ".join(
    f"WHEN {o.quoted(kind)} THEN replace({o.quoted(sql)}, '%s', CAST(event_id AS VARCHAR))" for kind, sql in _WRITES.items()
) + " END"


@query("p6_write_words", o.QL + f", s AS (SELECT gold_sql AS sql FROM query_log UNION ALL SELECT {_WRITES_SQL} FROM events) " + " UNION ALL ".join(
    f"SELECT {flag} AS case_sensitive, " + ", ".join(f"count(*) FILTER (contains({held}, {o.quoted(w)})) AS {w.lower().replace(' ', '_')}" for w in vocab.WRITE_WORDS) + " FROM s"
    for flag, held in (("true", "sql"), ("false", "upper(sql)"))
))
def write_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 with and without regard to case, on a log to which every event adds a statement that writes; read once."""
    written = F.lit(None).cast("string")
    for kind, sql in _WRITES.items():
        written = F.when(F.col("event_type") == kind, F.format_string(sql, "event_id")).otherwise(written)
    log = query_log(spark, sf_dir).select(gold().alias("sql")).unionByName(table(spark, sf_dir, "events").select(written.alias("sql")))
    counts = [F.struct(F.lit(cased).alias("case_sensitive"), *ops.write_words(F.col("sql"), cased)) for cased in (True, False)]
    return log.agg(F.array(*counts).alias("audit")).select(F.inline("audit"))


@query("p8_multi_table", REFS + "SELECT query_id FROM refs WHERE len(tabs) > 1")
def multi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = once(query_log(spark, sf_dir).select("query_id", "gold_sql"), n_tables=F.size(sqltext.table_refs(gold())))
    return log.where("n_tables > 1").select("query_id")


@query("a11_queries_per_db", o.QL + "SELECT db_id, count(*) AS n_queries FROM query_log GROUP BY db_id HAVING count(*) > 50")
def queries_per_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).groupBy("db_id").agg(F.count("*").alias("n_queries")).where("n_queries > 50")


@query("a12_tables_per_db", REFS + """SELECT db_id, t AS table_name, count(*) AS n_queries
  FROM (SELECT db_id, unnest(tabs) AS t FROM refs) AS x GROUP BY ALL""")
def tables_per_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = query_log(spark, sf_dir).select("db_id", F.explode(sqltext.table_refs(gold())).alias("table_name"))
    return used.groupBy("db_id", "table_name").agg(F.count("*").alias("n_queries"))


@query("a13_table_count_histogram", REFS + """SELECT n_tables, count(*) AS n_queries
  FROM (SELECT DISTINCT gold_sql, CAST(len(tabs) AS INTEGER) AS n_tables FROM refs) AS d GROUP BY 1""")
def table_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = query_log(spark, sf_dir).select("gold_sql").dropDuplicates()
    return (
        distinct.select(F.size(sqltext.table_refs(gold())).alias("n_tables"))
        .groupBy("n_tables")
        .agg(F.count("*").alias("n_queries"))
    )


@query("a14_log_means", REFS + f"""SELECT round(avg(len(tabs)), 6) AS avg_tables,
  round(avg({o.hits('gold_sql', 'JOIN')}), 6) AS avg_joins, count(*) AS n_queries FROM refs WHERE {STATEMENT}""")
def log_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = query_log(spark, sf_dir).where(sqltext.is_statement(gold()))
    return kept.select(
        F.size(sqltext.table_refs(gold())).alias("t"), F.regexp_count(gold(), F.lit("JOIN")).alias("j")
    ).agg(
        F.round(F.avg("t"), 6).alias("avg_tables"),
        F.round(F.avg("j"), 6).alias("avg_joins"),
        F.count("*").alias("n_queries"),
    )


def _present(name: str, pattern: str) -> str:
    if name == "filtering":
        return "regexp_matches(gold_sql, '(?i)(WHERE|HAVING).*(=|>|<|IN|BETWEEN|AND|OR|NOT|LIKE)')"
    if name == "top_k":
        return "contains(upper(gold_sql), 'ORDER BY ') AND contains(upper(gold_sql), 'LIMIT ')"
    if name == "nested":
        return "regexp_matches(gold_sql, '(?i)SELECT.*[(]SELECT')"
    return f"regexp_matches(gold_sql, {o.quoted(pattern)})"


_LONG = " UNION ALL ".join(
    f"SELECT db_id AS cluster, {o.quoted(n)} AS category FROM query_log WHERE {_present(n, p)}"
    for n, p in vocab.PRESENCE_PATTERNS.items()
)


@query("a15_category_breakdown", o.with_(query_log=QUERY_LOG_SQL, long=_LONG) + """SELECT category, cluster, count(*) AS n_queries
  FROM long GROUP BY GROUPING SETS ((category), (category, cluster))""")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.category_breakdown(query_log(spark, sf_dir), gold(), F.col("db_id"), vocab.PRESENCE_PATTERNS)


@query("q3_category_flags", o.QL + "SELECT query_id, " + ", ".join(
    f"{_present(n, p)} AS {n}" for n, p in vocab.PRESENCE_PATTERNS.items()) + " FROM query_log")
def category_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = sqltext.category_flags(gold(), vocab.PRESENCE_PATTERNS)
    return query_log(spark, sf_dir).select("query_id", *[f.alias(n) for n, f in flags.items()])


_EVERY = " + ".join(o.occurrences("gold_sql", n, p) for n, p in vocab.OCCURRENCE_PATTERNS.items())
_AGGS = " + ".join(o.occurrences("gold_sql", n, vocab.OCCURRENCE_PATTERNS[n]) for n in vocab.AGGREGATE_CATEGORIES)


@query("q4_profile", REFS + f"""SELECT count(*) AS n_queries, round(sum({_EVERY}) / count(*), 6) AS avg_keywords,
  round(avg(len({o.tokens('gold_sql')})), 6) AS avg_tokens, CAST(max(len({o.tokens('gold_sql')})) AS BIGINT) AS max_tokens,
  round(avg(len(list_distinct(list_transform(range(1, len({o.tokens('gold_sql')}) - 1), lambda i: {o.tokens('gold_sql')}[i:i + 2])))), 6) AS avg_trigrams,
  round(avg(len(tabs)), 6) AS avg_tables, CAST(max(len(tabs)) AS BIGINT) AS max_tables,
  round(avg(len(cols)), 6) AS avg_columns, CAST(max(len(cols)) AS BIGINT) AS max_columns,
  CAST(sum({o.hits('gold_sql', 'SELECT')}) AS BIGINT) AS total_nesting, CAST(sum({_AGGS}) AS BIGINT) AS total_aggregates,
  round(avg({o.hits('gold_sql', ' OVER ')}), 6) AS avg_windows FROM refs""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ops.profile(query_log(spark, sf_dir), gold())
    return report.select(*[F.round(c, 6).alias(c) if c.startswith("avg") else F.col(c) for c in report.columns])
