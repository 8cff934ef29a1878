"""Prompt assembly, option cleaning, validation and column samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylog import oracle_parts as o
from quarrylog.functions import sqltext, text, vocab
from quarrylog.inputs import NL_PAIRS_SQL, QUERY_LOG_SQL, SCHEMA_COLUMNS_SQL, nl_pairs, query_log, schema_columns, spread, table
from quarrylog.operators import log_context, prompts, sampling, validation
from quarrylog.registry import query

_SCHEMA = o.with_(schema_columns=SCHEMA_COLUMNS_SQL)
_DDL = """SELECT db_id, table_name, concat('CREATE TABLE ', table_name, chr(40), chr(10),
  concat_ws(',' || chr(10), string_agg('  ' || column_name || ' ' || data_type, ',' || chr(10) ORDER BY ordinal),
    string_agg('  PRIMARY KEY (' || column_name || ')', ',' || chr(10) ORDER BY ordinal DESC) FILTER (pkey = 'PRIMARY KEY'),
    string_agg('  FOREIGN KEY(' || column_name || ')' || substr(fkey, 12), ',' || chr(10) ORDER BY ordinal) FILTER (contains(fkey, 'FOREIGN KEY'))),
  chr(10), ')', chr(10), chr(10)) AS ddl FROM schema_columns GROUP BY db_id, table_name"""


@query("f21_table_ddl", _SCHEMA + _DDL)
def table_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.table_ddl(schema_columns(spark, sf_dir))


@query("s4_flat_catalog", _SCHEMA + """SELECT db_id, table_name, concat(upper(db_id), '-', table_name, ',', string_agg(column_name, ',' ORDER BY ordinal)) AS schema
  FROM schema_columns GROUP BY db_id, table_name""")
def flat_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.flat_catalog(schema_columns(spark, sf_dir))


@query("f30_db_table_split", _SCHEMA + "SELECT DISTINCT upper(db_id) AS db, table_name FROM schema_columns")
def db_table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.split(F.split("schema", ",")[0], "-", 2)
    return prompts.flat_catalog(schema_columns(spark, sf_dir)).select(cell[0].alias("db"), cell[1].alias("table_name"))


# The two shortest queries of a database are its examples; its question is the query's own description.
_EXAMPLES = """heads AS (SELECT db_id, query_id AS example, gold_sql, concat('Describe ', gold_sql) AS question FROM query_log
   QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY query_id) <= 3),
 x AS (SELECT q.query_id, q.db_id, q.gold_sql AS own, h.*, row_number() OVER (PARTITION BY q.query_id ORDER BY example) AS n FROM query_log q JOIN heads h USING (db_id) WHERE example <> q.query_id)"""


def _examples(log: DataFrame) -> DataFrame:
    return log.select(
        "db_id", F.col("query_id").alias("example"), F.col("gold_sql").alias("sql"),
        F.concat(F.lit("Describe "), F.col("gold_sql")).alias("question"),
    )


@query("f22_example_block", o.QL + f""", {_EXAMPLES}
SELECT query_id, string_agg(concat('### Example ', n - 1, ':', chr(10), 'SQL Query:', chr(10), gold_sql, chr(10), 'Gold Standard NL Question:', chr(10), question, chr(10), chr(10)), '' ORDER BY n) AS examples
  FROM x WHERE n <= 2 GROUP BY query_id""")
def example_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir)
    heads = prompts.first_per_group(_examples(log), ["db_id"], ["example"], 3, "pos").groupBy("db_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "example", "sql", "question"))).alias("heads")
    )
    joined = prompts.spread_join(log.select("query_id", "db_id"), heads, ["db_id"], ["query_id"])
    others = F.slice(F.filter("heads", lambda e: e["example"] != F.col("query_id")), 1, 2)
    return joined.select("query_id", prompts.example_block(others).alias("examples"))


@query("f23_prompt", o.with_(query_log=QUERY_LOG_SQL, schema_columns=SCHEMA_COLUMNS_SQL, ddl=_DDL) + f""", {_EXAMPLES},
 e AS (SELECT query_id, string_agg(concat('Question: ', question, ' ', chr(10), 'Answer: ', gold_sql, ' ', chr(10), chr(10), chr(10)), '' ORDER BY n) AS t FROM x WHERE n <= 2 GROUP BY query_id),
 d AS (SELECT db_id, string_agg(ddl, '' ORDER BY table_name) AS t FROM (SELECT * FROM ddl QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY table_name) <= 3) AS k GROUP BY db_id)
SELECT query_id, concat('Generate SQL given the question and tables to answer the question correctly.', chr(10), chr(10),
  e.t, chr(10), d.t, chr(10), 'Question: Describe ', gold_sql, chr(10), 'Answer:') AS prompt
  FROM query_log JOIN e USING (query_id) JOIN d USING (db_id)""")
def prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: every query's prompt with two examples and three tables of its database."""
    log = query_log(spark, sf_dir)
    ddl = prompts.table_ddl(schema_columns(spark, sf_dir))
    ranked = prompts.first_per_group(ddl.select("db_id", "table_name"), ["db_id"], ["table_name"], 3)
    questions = log.select("query_id", "db_id", F.concat(F.lit("Describe "), F.col("gold_sql")).alias("question"))
    return prompts.prompts(questions, _examples(log), ranked, ddl, "query_id", "db_id", 2, 3)


_LOG = o.with_(
    query_log=QUERY_LOG_SQL,
    **o.refs("query_log", "gold_sql"),
    u="SELECT query_id, db_id, gold_sql, unnest(tabs) AS table_name FROM refs",
    k="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db_id, table_name ORDER BY length(gold_sql), query_id) AS rank FROM u) AS r WHERE rank <= 5",
    n="SELECT db_id, table_name, count(*) AS n FROM k GROUP BY ALL",
    e="SELECT *, coalesce(sum(n) OVER (PARTITION BY db_id ORDER BY table_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM n",
    l="SELECT db_id, table_name, string_agg(concat('SQL: ', gold_sql, ' ', chr(10)), '' ORDER BY rank) AS lines FROM k JOIN (SELECT db_id, table_name FROM e WHERE spent < 12) AS x USING (db_id, table_name) GROUP BY ALL",
    **o.owned_columns("query_log", "gold_sql"),
    c="SELECT DISTINCT db_id, table_name AS a, column_name FROM owned_columns JOIN query_log USING (query_id)",
    g="SELECT db_id, a AS table_name, string_agg('  ' || column_name || ' TEXT', ',' || chr(10) ORDER BY column_name) AS cols FROM c GROUP BY ALL",
    d="SELECT db_id, table_name, concat('CREATE TABLE ', table_name, '(', chr(10), cols, chr(10), ')', chr(10)) AS ddl FROM g",
)


@query("f23_log_prompt", _LOG + """SELECT db_id, concat('*** FACTS ABOUT THE DATABASE ***', chr(10), chr(10), 'Fact#1: Keys are numbers ', chr(10), chr(10),
  '*** ALL THE TABLES IN THE DATABASE and QUERY LOGS *** ', chr(10), string_agg(concat(ddl, CASE WHEN lines IS NOT NULL THEN
  concat(chr(10), ' ** PREVIOUS SQL QUERIES THAT REFERRED TO THE TABLE ', table_name, ' **', chr(10), lines) ELSE '' END, chr(10)), '' ORDER BY table_name)) AS prompt
  FROM d LEFT JOIN l USING (db_id, table_name) GROUP BY db_id""")
def log_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables are those whose columns the log qualifies, by their own names or by an alias."""
    log = query_log(spark, sf_dir)
    named = log.select("db_id", F.explode(sqltext.owned_columns(F.col("gold_sql"))).alias("c"))
    columns = named.select("db_id", "c.*").distinct().select(
        "db_id", "table_name", F.lit(0).alias("ordinal"), "column_name",
        F.lit("TEXT").alias("data_type"), F.lit("").alias("pkey"), F.lit("").alias("fkey"),
    )
    chosen = log_context.table_log(log, "query_id", "db_id", "gold_sql", sqltext.table_refs(F.col("gold_sql")), cap=5, budget=12)
    texts = chosen.join(log.select("query_id", F.col("gold_sql").alias("sql")), "query_id")
    return prompts.log_prompt(prompts.table_ddl(columns), texts, "db_id", ["Keys are numbers"])


@query("f35_prompt_length", o.QL + "SELECT query_id, length(gold_sql) AS n_chars, 3000 - length(gold_sql) AS budget_left FROM query_log")
def prompt_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("gold_sql").cast("long")
    return query_log(spark, sf_dir).select("query_id", size.alias("n_chars"), (3000 - size).alias("budget_left"))


@query("f24_fixed_width", """WITH t AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS a, CAST(l_returnflag AS VARCHAR) AS b,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS n FROM lineitem) AS r WHERE n <= 5),
 w AS (SELECT l_orderkey, CAST(greatest(9, max(length(a))) AS INTEGER) AS wa, CAST(greatest(12, max(length(b))) AS INTEGER) AS wb FROM t GROUP BY 1)
SELECT l_orderkey, concat(rpad('l_partkey', any_value(wa), ' '), ' | ', rpad('l_returnflag', any_value(wb), ' '), chr(10), repeat('-', any_value(wa) + any_value(wb) + 3), chr(10),
  string_agg(rpad(a, wa, ' ') || ' | ' || rpad(b, wb, ' '), chr(10) ORDER BY n)) AS text FROM t JOIN w USING (l_orderkey) GROUP BY l_orderkey""")
def fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return prompts.fixed_width(lines, "l_orderkey", ["l_partkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_returnflag"])


@query("f5_cte_parts", o.QL + """SELECT query_id, 0 AS pos, 'big' AS title, regexp_extract(gold_sql, 'AS [(](SELECT.*)[)] SELECT', 1) AS sql FROM query_log WHERE starts_with(gold_sql, 'WITH ')
  UNION ALL SELECT query_id, 1, 'main', regexp_extract(gold_sql, '[)] (SELECT.*)$', 1) FROM query_log WHERE starts_with(gold_sql, 'WITH ')""")
def cte_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log(spark, sf_dir)
    parts = log.select("query_id", F.posexplode(sqltext.decompose(F.col("gold_sql"))).alias("pos", "p"))
    return parts.select("query_id", "pos", "p.title", "p.sql")


@query("q5_decomposition", o.QL + """SELECT query_id, db_id, 'big' AS title, regexp_extract(gold_sql, 'AS [(](SELECT.*)[)] SELECT', 1) AS gold_sql, '' AS question, false AS adjusted FROM query_log WHERE starts_with(gold_sql, 'WITH ')
  UNION ALL SELECT query_id, db_id, 'main', regexp_extract(gold_sql, '[)] (SELECT.*)$', 1), '', false FROM query_log WHERE starts_with(gold_sql, 'WITH ')""")
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = query_log(spark, sf_dir).where(sqltext.is_nested(F.col("gold_sql")))
    parts = nested.select("query_id", "db_id", F.explode(sqltext.decompose(F.col("gold_sql"))).alias("p"))
    return parts.select(
        "query_id", "db_id", "p.title", F.col("p.sql").alias("gold_sql"), F.lit("").alias("question"), F.lit(False).alias("adjusted")
    )


@query("f25_annotated_ctes", o.QL + r"""SELECT query_id, concat(regexp_replace(gold_sql, '^WITH big AS [(](.*)[)] SELECT', 'WITH -- part ' || db_id || chr(10) || 'big AS (\1)' || chr(10) || '-- whole' || chr(10) || ' SELECT')) AS sql
  FROM query_log WHERE starts_with(gold_sql, 'WITH ')""")
def annotated_ctes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = F.array(
        F.struct(F.lit("big").alias("title"), F.concat(F.lit("part "), F.col("db_id")).alias("note")),
        F.struct(F.lit("main").alias("title"), F.lit("whole").alias("note")),
    )
    rows = query_log(spark, sf_dir).where(F.col("gold_sql").startswith("WITH "))
    return rows.select("query_id", sqltext.annotate_ctes(F.col("gold_sql"), notes).alias("sql"))


_LINES = """SELECT conv_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT conv_id, turn,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(upper(x), 'OPTION') AND NOT contains(x, ':')) AS l FROM conversations) AS s"""


@query("p12_option_lines", f"""WITH o AS ({_LINES}), w AS (SELECT *, regexp_extract_all(line, '\\S+') AS p FROM o)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, CASE WHEN length(p[1]) < 5 AND NOT regexp_full_match(p[1], '\\p{{L}}+')
  THEN array_to_string(p[2:], ' ') ELSE line END AS option FROM w""")
def option_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 and F9 over whole turns."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(text.option_lines(F.col("text"))).alias("pos", "option"))


_LONG_LINES = """SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
   lambda x: x <> '' AND NOT contains(upper(x), 'OPTION') AND NOT contains(x, ':')), lambda x: CASE WHEN length(regexp_extract(x, '\\S+')) < 5
   AND NOT regexp_full_match(regexp_extract(x, '\\S+'), '\\p{L}+') THEN array_to_string(regexp_extract_all(x, '\\S+')[2:], ' ') ELSE x END), lambda x: length(x) > 3) AS l FROM conversations"""


@query("p12_combined_options", f"SELECT conv_id, turn, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS option FROM ({_LONG_LINES}) AS s")
def combined_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 on the combined path: only options of more than three characters, numbered anew."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(text.long_options(text.option_lines(F.col("text")))).alias("pos", "option"))


@query("f9_clean_marker", """WITH w AS (SELECT item_id, text, regexp_extract_all(text, '\\S+') AS p FROM benchmark)
SELECT item_id, CASE WHEN length(p[1]) < 5 AND NOT regexp_full_match(p[1], '\\p{L}+') THEN array_to_string(p[2:], ' ') ELSE text END AS cleaned FROM w""")
def clean_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.clean_marker(F.col("text")).alias("cleaned"))


@query("f10_numbered_options", o.QL + r""", t AS (SELECT query_id, concat('1. ', gold_sql, ' 2. ', pred_sql, CASE WHEN query_id % 2 = 0 THEN ' 3: ' || db_id || ' as written' ELSE '' END) AS x FROM query_log)
SELECT query_id, array_to_string(list_filter(string_split_regex(x, CASE WHEN contains(x, ':') THEN '[0-9]+:\s' ELSE '[0-9]+\.\s' END), lambda s: length(s) > 10), '|') AS options FROM t""")
def numbered_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colon in the answer switches the marks that part it."""
    marked = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit(" 3: "), F.col("db_id"), F.lit(" as written"))).otherwise("")
    answer = F.concat(F.lit("1. "), F.col("gold_sql"), F.lit(" 2. "), F.col("pred_sql"), marked)
    return query_log(spark, sf_dir).select("query_id", F.array_join(text.split_numbered(answer), "|").alias("options"))


@query("f11_candidate_split", o.QL + """SELECT query_id, unnest([0, 1]) AS pos, unnest([gold_sql, pred_sql]) AS candidate FROM query_log""")
def candidate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.col("gold_sql"), F.lit("; ;"), F.col("pred_sql"), F.lit(";"))
    return query_log(spark, sf_dir).select("query_id", F.posexplode(text.split_candidates(answer)).alias("pos", "candidate"))


@query("f12_fence_strip", o.QL + "SELECT query_id, gold_sql AS sql FROM query_log")
def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("```sql\n"), F.col("gold_sql"), F.lit("\n```"))).otherwise(F.col("gold_sql"))
    return query_log(spark, sf_dir).select("query_id", sqltext.strip_fence(fenced).alias("sql"))


@query("f13_sanitised_names", "SELECT p_partkey, concat('SELECT `', replace(p_name, ' ', '_'), '_', replace(replace(p_brand, '#', '-'), '-', ''), '` FROM part') AS sql FROM part")
def sanitised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("SELECT `"), F.col("p_name"), F.lit(" ("), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(")` FROM part"))
    return table(spark, sf_dir, "part").select("p_partkey", sqltext.sanitise_quoted(quoted).alias("sql"))


@query("f19_significant", "SELECT o_orderkey, CAST(printf('%.2e', o_totalprice) AS DOUBLE) AS price FROM orders")
def significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.significant(F.col("o_totalprice")).alias("price"))


@query("f20_short_value", "SELECT item_id, substr(text, 1, 25) AS short FROM benchmark")
def short_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.short_value(F.col("text")).alias("short"))


@query("f20_short_number", "SELECT l_orderkey, l_linenumber, printf('%.3g', l_extendedprice) AS price, printf('%.3g', l_discount) AS discount, printf('%.3g', l_quantity) AS quantity FROM lineitem")
def short_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [text.short_number(F.col(f"l_{c}")).alias(n) for c, n in (("extendedprice", "price"), ("discount", "discount"), ("quantity", "quantity"))]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *shown)


@query("f8_trigrams", """WITH t AS (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS t FROM benchmark)
SELECT item_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS gram FROM t WHERE len(t) >= 3""")
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.ngrams(sqltext.tokens(F.col("text")), 3)).alias("gram"))


@query("f16_drop_specials", "SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^a-zA-Z\\s]', '', 'g') AS text FROM pages")
def drop_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", text.drop_specials(plain).alias("text"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


@query("f17_drop_stop_words", f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '\\S+'), lambda w: NOT list_contains({_STOP}, lower(w))), ' ') AS text FROM documents")
def drop_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.drop_stop_words(F.col("text")).alias("text"))


@query("f14_fold_accents", "SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(strip_accents(text)), '[^\\x00-\\x7F]', '', 'g'), '', '', 'g') AS text FROM documents")
def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.fold_accents(F.col("text")).alias("text"))


@query("f15_contractions", "SELECT conv_id, turn, replace(text, '''', '') AS text FROM conversations")
def contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.expand_contractions(F.col("text")).alias("text"))


#: Openings with contractions, and what they become.
_OPENINGS = [
    ("I'm sure they can't: ", "I am sure they can not: "),
    ("WE'LL see, it's done: ", "We will see, it is done: "),
    ("She shouldn't've, the dog's tail: ", "She should not have, the dogs tail: "),
    ("Y'all won't: ", "You all will not: "),
    ("'cause ", "because "),
]
_EXPANDED = "CASE item_id % 5 " + " ".join(f"WHEN {i} THEN {o.quoted(full)}" for i, (_, full) in enumerate(_OPENINGS)) + " END"


@query("f15_contractions_found", f"SELECT item_id, concat({_EXPANDED}, replace(text, chr(39), '')) AS text FROM benchmark")
def contractions_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15 on passages that open with contractions."""
    opening = F.element_at(F.array(*[F.lit(short) for short, _ in _OPENINGS]), (F.col("item_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.expand_contractions(F.concat(opening, "text")).alias("text"))


@query("f18_normalised")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.normalise(F.col("text")).alias("text"))


@query("f31_timestamps", "SELECT event_id, epoch_us(ts) / 1e6 AS seconds, strftime(ts, '%Y-%m-%d') AS day FROM events")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    )


@query("f32_parsed_literals", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parsed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("f33_info_label", "SELECT doc_id, concat('query_id:', doc_id, ', cluster_id:', source, ', cluster_size:', count(*) OVER (PARTITION BY source)) AS info FROM documents")
def info_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    sized = prompts.spread_join(docs, docs.groupBy("source").agg(F.count("*").alias("size")), ["source"], ["doc_id"], n="size")
    label = F.concat(F.lit("query_id:"), F.col("doc_id"), F.lit(", cluster_id:"), F.col("source"), F.lit(", cluster_size:"), F.col("size"))
    return sized.select("doc_id", label.alias("info"))


@query("f34_bullets", o.QL + "SELECT query_id, concat(chr(8226), ' ', gold_sql, chr(10), chr(8226), ' ', pred_sql) AS options FROM query_log")
def bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.transform(F.array("gold_sql", "pred_sql"), lambda x: F.concat(F.lit("• "), x))
    return query_log(spark, sf_dir).select("query_id", F.array_join(options, "\n").alias("options"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nl_pairs(spark, sf_dir).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.length("generated") > 200, F.col("generated")).alias("sql"), F.col("reference").alias("question")
    )


@query("p1_ingest", o.with_(nl_pairs=NL_PAIRS_SQL) + """SELECT concat_ws('-', conv_id, turn) AS id, generated AS gold_sql, reference AS gold_question,
  '' AS sql, '' AS question, '' AS comment, false AS adjusted, 0 AS n_options, '' AS db_id FROM nl_pairs""")
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = nl_pairs(spark, sf_dir).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("generated").alias("sql"), F.col("reference").alias("question")
    )
    return validation.ingest(records).withColumn("n_options", F.size("options")).drop("options")


@query("p2_record_violations", o.with_(nl_pairs=NL_PAIRS_SQL) + "SELECT concat_ws('-', conv_id, turn) AS item, 'sql' AS problem, 'record' AS \"check\" FROM nl_pairs WHERE length(generated) <= 200")
def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.record_violations(_records(spark, sf_dir), "id")


_VIOLATIONS = o.with_(nl_pairs=NL_PAIRS_SQL) + """, v AS (SELECT concat_ws('-', conv_id, turn) AS item, 'sql' AS problem, 'record' AS "check" FROM nl_pairs WHERE length(generated) <= 200
  UNION ALL SELECT unnest(['table', 'columnname', 'data-type', 'description']), 'missing column', 'schema')"""


@query("p4_validation_report", _VIOLATIONS + ' SELECT "check", problem, count(*) AS n_items, min(item) AS first_item FROM v GROUP BY ALL')
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table stands for an uploaded schema file that lacks every required column."""
    schema_file = table(spark, sf_dir, "events")
    return validation.roll_up(validation.record_violations(_records(spark, sf_dir), "id"), validation.missing_columns(schema_file))


_REJECTS = o.with_(nl_pairs=NL_PAIRS_SQL) + ", r AS (SELECT concat_ws('-', conv_id, turn) AS id, length(generated) <= 200 AS no_sql, reference IS NULL AS no_question FROM nl_pairs)"


@query("p4_validation_flags", _REJECTS + """ SELECT 'record' AS "check", count(*) AS n_items, count(*) FILTER (no_sql OR no_question) AS n_rejected, count(*) FILTER (no_sql OR no_question) = 0 AS passed FROM r
  UNION ALL SELECT 'schema', 4, 4, false""")
def validation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each check passed. The events table stands for a schema file without the required columns."""
    found = validation.split_valid(_records(spark, sf_dir), validation.record_errors())
    absent = validation.missing_columns(table(spark, sf_dir, "events")).count()
    required = len(validation.REQUIRED_SCHEMA_COLUMNS)
    rows = [("record", found.n, found.n_rejected, found.passed), ("schema", required, absent, absent == 0)]
    return spark.createDataFrame(rows, "check string, n_items long, n_rejected long, passed boolean")


@query("p4_rejects", _REJECTS + """ SELECT id, concat_ws(', ', CASE WHEN no_sql THEN 'no sql' END, CASE WHEN no_question THEN 'no question' END) AS errors FROM r WHERE no_sql OR no_question""")
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rejected record with all that is wrong with it."""
    found = validation.split_valid(_records(spark, sf_dir), validation.record_errors())
    return found.rejected.select("id", F.array_join("errors", ", ").alias("errors"))


_CELLS = "SELECT l_suppkey, unnest(['l_partkey', 'l_returnflag']) AS col, unnest([CAST(l_partkey AS VARCHAR), CAST(l_returnflag AS VARCHAR)]) AS value, l_orderkey * 8 + l_linenumber AS pos FROM lineitem"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines stand for one table of two columns."""
    pair = lambda name: F.struct(F.lit(name).alias("col"), F.col(name).cast("string").alias("value"))
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.inline(F.array(pair("l_partkey"), pair("l_returnflag"))), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos")
    ).select("l_suppkey", "col", "value", "pos")


_SAMPLES = f"""WITH c AS ({_CELLS}), s AS (SELECT l_suppkey, col, string_agg(substr(value, 1, 25), ',' ORDER BY pos, value) AS sample FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey, col ORDER BY pos, value) <= 3) AS f GROUP BY ALL),
 d AS (SELECT l_suppkey, col, value, min(pos) AS p FROM c GROUP BY ALL),
 v AS (SELECT l_suppkey, col, string_agg(value, ',' ORDER BY p, value) AS distinct_values FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY l_suppkey, col ORDER BY p, value) <= 3) AS f GROUP BY ALL)"""


@query("c2_column_samples", _SAMPLES + " SELECT l_suppkey, col, sample, distinct_values FROM s JOIN v USING (l_suppkey, col)")
def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = prompts.column_samples(_cells(spark, sf_dir), "l_suppkey", "col", "pos", "value")
    return samples.select("l_suppkey", "col", F.array_join("sample", ",").alias("sample"), F.array_join("distinct_values", ",").alias("distinct_values"))


_CLASSES = o.quoted(", ".join(vocab.COLUMN_CLASSES))
_NAMED = "col, '` with values `', replace(distinct_values, ',', ', '), '`"


@query("c1_column_question", _SAMPLES + f""", f AS (SELECT l_suppkey, col, sample, distinct_values, unnest(['select', 'check', 'new']) AS form FROM s JOIN v USING (l_suppkey, col))
  SELECT l_suppkey, col, form, concat('Consider the column `', col, '` in the data sample below.', chr(10), replace(sample, ',', chr(10)), chr(10), chr(10), CASE form
    WHEN 'select' THEN concat('Select the class a column called `', {_NAMED} from the list:')
    WHEN 'check' THEN concat('Suggest a semantic type for the column `', {_NAMED}:') ELSE concat('Suggest a new semantic type for the column `', {_NAMED}:') END,
   chr(10), chr(10), {_CLASSES}, chr(10), chr(10), CASE form WHEN 'select' THEN 'Reply with only one word from the list.'
    WHEN 'check' THEN 'Does the column fit any of the possible classes? Reply "Yes" or "No".' ELSE 'Reply with only one word: the new semantic type.' END) AS question FROM f""")
def column_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column is asked about in all three forms, over the whole list of classes."""
    samples = prompts.column_samples(_cells(spark, sf_dir), "l_suppkey", "col", "pos", "value")
    classes = F.array(*[F.lit(c) for c in vocab.COLUMN_CLASSES])
    asked = prompts.column_questions(F.col("col"), F.col("sample"), F.col("distinct_values"), classes)
    return samples.select("l_suppkey", "col", F.inline(asked))


@query("c3_seeded_shuffle", """SELECT doc_id FROM (SELECT doc_id FROM labels ORDER BY doc_id LIMIT 50) AS f ORDER BY md5(concat('0-', CAST(doc_id AS VARCHAR)))""")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "labels").select("doc_id").orderBy("doc_id").limit(50)
    return first.orderBy(sampling.seeded_order(0, F.col("doc_id")))


@query("c4_growing_labels", """WITH f AS (SELECT event_type, min(event_id) AS event_id FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type)
SELECT event_id, event_type, f.event_id IS NOT NULL AS new_class, 2 + (SELECT count(*) FROM f x WHERE x.event_id <= e.event_id) AS known_classes
  FROM events e LEFT JOIN f USING (event_id, event_type)""")
def growing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.growing_labels(table(spark, sf_dir, "events"), "event_id", "event_type", ["click", "view"])


#: What a column typer answered, by kind of event; two answers are no class of the vocabulary.
_ANSWERS = {"view": "WEBSITE", "click": "CALL_TO_ACTION_URL", "error": "NO_DISPLAY", "purchase": "PRICE_RANGE", "signup": "USER"}
_LABEL = "CASE event_type " + " ".join(f"WHEN '{kind}' THEN '{answer}'" for kind, answer in _ANSWERS.items()) + " END"


@query("p9_vocabulary_filter", f"SELECT event_id, label FROM (SELECT event_id, {_LABEL} AS label FROM events) AS e WHERE label IN (" + ", ".join(f"'{c}'" for c in vocab.COLUMN_CLASSES) + ")")
def vocabulary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are a class of the whole vocabulary."""
    label: Column = F.lit(None).cast("string")
    for kind, answer in _ANSWERS.items():
        label = F.when(F.col("event_type") == kind, answer).otherwise(label)
    return table(spark, sf_dir, "events").select("event_id", label.alias("label")).where(F.col("label").isin(vocab.COLUMN_CLASSES))
