"""Queries matched to tables, databases and other queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.functions import sqltext
from quarrylog.functions.scores import overlap_ratio, table_overlap
from quarrylog.inputs import QUERY_LOG_SQL, SCHEMA_COLUMNS_SQL, query_log, schema_columns
from quarrylog.operators import catalog_match as ops
from quarrylog.operators.compute import once
from quarrylog.operators.joins import first_per_group
from quarrylog.registry import query
from quarrylog.session import cut_lineage


def gold() -> Column:
    return F.col("gold_sql")


def used_tables() -> Column:
    return sqltext.table_refs(gold())


REFS = o.with_(query_log=QUERY_LOG_SQL, **o.refs("query_log", "gold_sql"))

# The known tables: those that predictions with a JOIN use.
_CATALOG_SQL = "SELECT DISTINCT unnest(p_tabs) AS table_name FROM p_refs WHERE contains(pred_sql, 'JOIN')"
_BOTH = o.with_(
    query_log=QUERY_LOG_SQL,
    **o.refs("query_log", "gold_sql"),
    **o.refs("query_log", "pred_sql", "p_"),
    catalog=_CATALOG_SQL,
)


def _catalog(log: DataFrame) -> DataFrame:
    joined = log.where(F.col("pred_sql").contains("JOIN"))
    return joined.select(F.explode(sqltext.table_refs(F.col("pred_sql"))).alias("table_name")).distinct()


@query("j2_known_tables", _BOTH + """SELECT query_id, array_to_string(list_sort(list(table_name)), ',') AS tables
  FROM (SELECT query_id, unnest(tabs) AS table_name FROM refs) AS u SEMI JOIN catalog USING (table_name) GROUP BY query_id""")
def known_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir)
    return ops.known_tables(log, "query_id", used_tables(), _catalog(log)).withColumn("tables", F.array_join("tables", ","))


@query("u7_catalog_intersection", _BOTH + """SELECT table_name, count(*) AS n_queries
  FROM (SELECT query_id, unnest(tabs) AS table_name FROM refs) AS u SEMI JOIN catalog USING (table_name) GROUP BY ALL""")
def catalog_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir)
    counts = ops.table_index(log, "query_id", used_tables()).groupBy("table_name").agg(F.count("*").alias("n_queries"))
    return counts.join(_catalog(log), "table_name", "left_semi")


@query("j15_table_index", REFS + "SELECT unnest(tabs) AS table_name, query_id FROM refs")
def table_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.table_index(query_log(spark, sf_dir), "query_id", used_tables())


# A database owns the tables it uses at least as often as the average database does.
_OWNED_SQL = """SELECT db_id, table_name, n FROM (
  SELECT db_id, table_name, n, avg(n) OVER (PARTITION BY table_name) AS m FROM (
    SELECT db_id, table_name, count(*) AS n FROM (SELECT db_id, unnest(tabs) AS table_name FROM refs) AS u
    GROUP BY ALL) AS c) AS a WHERE n >= m"""


def _owned(log: DataFrame) -> DataFrame:
    counts = (
        log.select("db_id", F.explode(used_tables()).alias("table_name"))
        .groupBy("db_id", "table_name")
        .agg(F.count("*").alias("n"))
    )
    means = counts.groupBy("table_name").agg(F.avg("n").alias("m"))
    return counts.join(means, "table_name").where("n >= m").select("db_id", "table_name", "n")


@query("j8_owning_database", o.with_(query_log=QUERY_LOG_SQL, **o.refs("query_log", "gold_sql"), owned=_OWNED_SQL) + """
SELECT query_id, (SELECT max(db_id) FROM (SELECT db_id FROM owned WHERE list_contains(refs.tabs, table_name)
  GROUP BY db_id HAVING count(*) = len(refs.tabs)) AS held) AS owner FROM refs""")
def owning_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir)
    return ops.owning_database(log, "query_id", used_tables(), _owned(log), "db_id", "table_name")


_QUALIFIED = o.with_(
    query_log=QUERY_LOG_SQL,
    **o.owned_columns("query_log", "gold_sql"),
    named="SELECT query_id, list_sort(list(table_name || '.' || column_name)) AS cols FROM owned_columns GROUP BY query_id",
    seen="SELECT query_id, db_id, coalesce(cols, []) AS cols FROM query_log LEFT JOIN named USING (query_id)",
    counts="SELECT db_id, c, count(*) AS n FROM (SELECT db_id, unnest(cols) AS c FROM seen) AS u GROUP BY ALL",
    owned="SELECT db_id, c FROM (SELECT *, avg(n) OVER (PARTITION BY c) AS m FROM counts) AS a WHERE n >= m",
    sets="SELECT DISTINCT cols FROM seen WHERE len(cols) > 0",
    held="SELECT cols, min(db_id) AS owner FROM (SELECT cols, db_id FROM sets JOIN owned ON list_contains(cols, c)"
    " GROUP BY ALL HAVING count(*) = len(cols)) AS h GROUP BY cols",
)


def _qualified_owners(log: DataFrame) -> DataFrame:
    log = cut_lineage(log.select("query_id", "db_id", sqltext.owned_columns(gold()).alias("columns")))
    pairs = F.transform("columns", lambda c: F.concat_ws(".", c["table_name"], c["column_name"]))
    counts = log.select("db_id", F.explode(pairs).alias("c")).groupBy("db_id", "c").agg(F.count("*").alias("n"))
    means = counts.groupBy("c").agg(F.avg("n").alias("m"))
    catalog = counts.join(means, "c").where("n >= m")
    return ops.owning_database(log, "query_id", pairs, catalog, "db_id", "c", last_wins=False)


@query("j9_column_containment", _QUALIFIED + "SELECT query_id, owner FROM seen LEFT JOIN held USING (cols)")
def column_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qualified_owners(query_log(spark, sf_dir))


@query("j9_unmatched", _QUALIFIED + "SELECT query_id FROM seen ANTI JOIN held USING (cols)")
def column_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qualified_owners(query_log(spark, sf_dir)).where("owner IS NULL").select("query_id")


@query("j10_shared_names", o.with_(query_log=QUERY_LOG_SQL, **o.refs("query_log", "gold_sql"), owned=_OWNED_SQL) + """,
 pairs AS (SELECT a.table_name, a.n % 3 AS x, b.n % 3 AS y FROM owned a JOIN owned b ON a.table_name = b.table_name AND a.db_id < b.db_id)
SELECT count(*) AS same_name_pairs, count(*) FILTER (x = y) AS same_schema_pairs FROM pairs""")
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The remainder of the use count stands for the table's definition.
    owned = _owned(query_log(spark, sf_dir)).withColumn("body", F.col("n") % 3)
    return ops.shared_names(owned, "db_id", "table_name", "body")


_OVERLAP = o.with_(
    query_log=QUERY_LOG_SQL,
    **o.refs("query_log", "gold_sql"),
    q="SELECT query_id, list_sort(tabs) AS tabs FROM refs WHERE len(tabs) > 0",
    firsts="SELECT tabs, query_id FROM q QUALIFY row_number() OVER (PARTITION BY tabs ORDER BY query_id) <= 6",
    sets="SELECT DISTINCT tabs FROM q",
    cands="""SELECT a.tabs, f.query_id AS id, len(list_intersect(a.tabs, f.tabs))
      - abs(len(a.tabs) - len(f.tabs)) / len(a.tabs) AS score FROM sets a JOIN firsts f ON true""",
    best="SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY tabs ORDER BY score DESC, id) <= 6",
    ranked="""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank,
      id AS other_query_id, score FROM q JOIN best USING (tabs) WHERE id <> query_id""",
)


@query("j7_overlap_top5", _OVERLAP + "SELECT * FROM ranked WHERE rank <= 5")
def overlap_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.overlapping_queries(query_log(spark, sf_dir), "query_id", used_tables(), 5)


@query("j11_leave_one_out", o.with_(
    query_log=QUERY_LOG_SQL,
    heads="SELECT db_id, query_id AS example FROM query_log QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY length(gold_sql), query_id) <= 4",
) + """SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(e.gold_sql), example) AS INTEGER) AS rank,
  example FROM query_log q JOIN heads USING (db_id) JOIN (SELECT query_id AS eid, gold_sql FROM query_log) e ON e.eid = example
  WHERE example <> query_id) AS r WHERE rank <= 3""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir).withColumn("sql_length", F.length("gold_sql"))
    return ops.examples_without_self(log, "query_id", "db_id", ["sql_length"], 3)


@query("u8_overlap_ratio", o.QL + """SELECT query_id, len(list_intersect(g, p)) / greatest(len(g), len(p)) AS overlap FROM (
  SELECT query_id, list_distinct(string_split(gold_sql, ' ')) AS g, list_distinct(string_split(pred_sql, ' ')) AS p FROM query_log) AS s""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = (F.array_distinct(F.split(c, " ")) for c in ("gold_sql", "pred_sql"))
    return query_log(spark, sf_dir).select("query_id", overlap_ratio(gold, pred).alias("overlap"))


@query("v4_table_overlap", _BOTH + """SELECT refs.query_id, len(list_intersect(tabs, p_tabs)) - abs(len(tabs) - len(p_tabs)) / len(tabs) AS score
  FROM refs JOIN p_refs ON refs.query_id = p_refs.query_id WHERE len(tabs) > 0""")
def table_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir).select("query_id", "gold_sql", "pred_sql")
    rows = once(log, g=used_tables(), p=sqltext.table_refs(F.col("pred_sql"))).where("size(g) > 0")
    return rows.select("query_id", table_overlap(F.col("g"), F.col("p")).alias("score"))


@query("u4_table_union", REFS + "SELECT DISTINCT unnest(tabs) AS table_name FROM refs")
def table_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select(F.explode(used_tables()).alias("table_name")).distinct()


@query("t13_sorted_tables", REFS + "SELECT DISTINCT unnest(tabs) AS table_name FROM refs ORDER BY table_name")
def sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_union(spark, sf_dir).orderBy("table_name")


@query("u6_subset_test", _BOTH + """SELECT refs.query_id, len(list_filter(p_tabs, lambda t: NOT list_contains(tabs, t))) = 0 AS pred_in_gold
  FROM refs JOIN p_refs ON refs.query_id = p_refs.query_id""")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.size(F.array_except(sqltext.table_refs(F.col("pred_sql")), used_tables()))
    return query_log(spark, sf_dir).select("query_id", (missing == 0).alias("pred_in_gold"))


@query("u5_union_of_frames", o.QL + """SELECT query_id, gold_sql AS sql, NULL AS user_name FROM query_log
  UNION ALL SELECT query_id, pred_sql, concat('u', user_id) FROM query_log""")
def union_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir)
    gold = log.select("query_id", F.col("gold_sql").alias("sql"))
    pred = log.select("query_id", F.col("pred_sql").alias("sql"), F.concat(F.lit("u"), "user_id").alias("user_name"))
    return gold.unionByName(pred, allowMissingColumns=True)


@query("f26_rownum_rewrite", o.QL + """SELECT query_id, CASE WHEN contains(gold_sql, 'LIMIT ')
  THEN concat('SELECT * FROM (', split_part(gold_sql, 'LIMIT ', 1), ') WHERE ROWNUM <=', regexp_extract(gold_sql, 'LIMIT ([0-9]+)', 1))
  ELSE gold_sql END AS sql FROM query_log""")
def rownum_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select("query_id", sqltext.limit_to_rownum(gold()).alias("sql"))


_QUALIFY = "gold_sql"
for _t in ("customer", "orders", "nation", "region", "part", "supplier", "lineitem"):
    _QUALIFY = o.replaced(_QUALIFY, rf"([ (,]){_t}( |$|\))", rf"\1OWNER.{_t}\2")


@query("f27_owner_prefix", o.QL + f"SELECT query_id, {_QUALIFY} AS sql FROM query_log")
def owner_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log(spark, sf_dir).select("query_id", sqltext.qualify_tables(gold(), used_tables(), "OWNER").alias("sql"))


_CATALOG_NAMES = "gold_sql"
for _t in ("customer", "orders", "nation", "region", "part", "supplier", "lineitem"):
    _CATALOG_NAMES = o.replaced(_CATALOG_NAMES, rf"([\s.(]){_t}([\s.)])", rf"\1 'DW-{_t}'\2")


@query("f27_catalog_names", o.QL + f"SELECT query_id, {_CATALOG_NAMES} AS sql FROM query_log")
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27, second form: tables under the names of a foreign catalog."""
    return query_log(spark, sf_dir).select("query_id", sqltext.catalog_names(gold(), used_tables(), "DW").alias("sql"))


_FK = o.with_(schema_columns=SCHEMA_COLUMNS_SQL)


@query("j4_foreign_keys", _FK + """SELECT c.db_id, c.table_name, c.column_name, r.table_name AS ref_table, r.column_name AS ref_column
  FROM schema_columns c JOIN schema_columns r ON c.db_id = r.db_id AND regexp_extract(c.fkey, 'KEY (T[0-9]+)', 1) = r.table_name
  WHERE c.fkey <> '' AND r.pkey <> ''""")
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = schema_columns(spark, sf_dir)
    keys = columns.where("fkey <> ''").select(
        "db_id", "table_name", "column_name", F.regexp_extract("fkey", r"KEY (T[0-9]+)", 1).alias("ref_table")
    )
    targets = columns.where("pkey <> ''").select(
        "db_id", F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column")
    )
    return keys.join(targets, ["db_id", "ref_table"]).select(
        "db_id", "table_name", "column_name", "ref_table", "ref_column"
    )


@query("p18_table_columns", _FK + """SELECT table_name, column_name, upper(data_type) AS data_type FROM schema_columns""")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays per table, as a schema JSON holds them, flattened back to one row per column."""
    arrays = (
        schema_columns(spark, sf_dir)
        .groupBy("table_name")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type"))).alias("c"))
        .select("table_name", F.col("c.column_name").alias("names"), F.col("c.data_type").alias("types"))
    )
    return arrays.select("table_name", F.explode(F.arrays_zip("names", "types")).alias("c")).select(
        "table_name", F.col("c.names").alias("column_name"), F.upper("c.types").alias("data_type")
    )


@query("j3_schema_lookup", _BOTH + """SELECT table_name, count(*) AS n_queries, bool_or(c.t IS NULL) AS missing
  FROM (SELECT query_id, unnest(tabs) AS table_name FROM refs) AS u LEFT JOIN (SELECT table_name AS t FROM catalog) AS c
  ON t = table_name GROUP BY table_name""")
def schema_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir)
    used = ops.table_index(log, "query_id", used_tables()).groupBy("table_name").agg(F.count("*").alias("n_queries"))
    known = _catalog(log).withColumn("known", F.lit(True))
    return used.join(known, "table_name", "left").select(
        "table_name", "n_queries", F.col("known").isNull().alias("missing")
    )


@query("p11_prefix_exclusion", o.QL + """SELECT db_id, query_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT db_id, query_id, row_number() OVER (PARTITION BY db_id ORDER BY length(gold_sql) DESC, query_id) AS rank
  FROM query_log WHERE NOT starts_with(gold_sql, 'WITH ')) AS r WHERE rank <= 10""")
def prefix_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = query_log(spark, sf_dir).where(~gold().startswith("WITH "))
    ranked = kept.select("db_id", "query_id", F.length("gold_sql").alias("n"))
    return first_per_group(ranked, ["db_id"], [F.desc("n"), "query_id"], 10).select("db_id", "query_id", "rank")
