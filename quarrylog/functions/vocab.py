"""Fixed values that results depend on."""

# SQL words whose presence in a log is counted.
SQL_KEYWORDS = """
SELECT INSERT UPDATE DELETE FROM WHERE JOIN LEFT RIGHT FULL INNER OUTER GROUP ORDER BY HAVING DISTINCT CREATE
ALTER DROP INDEX UNION ALL VALUES INTO AS SET AND OR NOT ON LIMIT OFFSET LIKE IN BETWEEN IS NULL PRIMARY FOREIGN
KEY REFERENCES EXISTS CAST CASE WHEN THEN ELSE END EXCEPT INTERSECT TABLE VIEW TRIGGER PROCEDURE FUNCTION DATABASE
USE GRANT REVOKE WITH REPLACE CHECK DEFAULT CONSTRAINT TRUNCATE COMMIT ROLLBACK SAVEPOINT TRANSACTION SEQUENCE
CURSOR FETCH DECLARE OPEN CLOSE LOOP WHILE MERGE MINUS RETURNING SYNONYM START BEGIN ELSEIF PACKAGE PARTITION
RENAME EXPLAIN ANALYZE LOG READ ONLY LOCK SHARE USER PASSWORD EXCLUSIVE UNIQUE ROWNUM INTERVAL CURRENT_DATE
CURRENT_TIMESTAMP SYSDATE SYSTIMESTAMP SESSION SYSTEM LEVEL RANK DENSE_RANK ROW_NUMBER PERCENT_RANK CUME_DIST NTILE
LAG LEAD FIRST_VALUE LAST_VALUE LISTAGG GROUPING CUBE ROLLUP OVER WINDOW RANGE ROWS
""".split() + [
    "ORDER BY",
    "PARTITION BY",
    "UNBOUNDED PRECEDING",
    "CURRENT ROW",
    "NULLS FIRST",
    "NULLS LAST",
]

# Workload categories counted by occurrence, case-sensitive.
# (?d) makes "." stop at a line feed only.
OCCURRENCE_PATTERNS = {
    "selection": r"SELECT",
    "filtering": r"(?d)^(?=.*(?:WHERE|HAVING)(?:.*(?:=|>|<|IN|BETWEEN|AND|OR|NOT|LIKE)))",
    "aggregation": r"\b(?:SUM|AVG|MAX|MIN)\b",
    "counting": r"COUNT",
    "summing": r"SUM",
    "min": r"MIN",
    "max": r"MAX",
    "averaging": r"AVG",
    "group_concat": r"GROUP_CONCAT|STRING_AGG",
    "stats": r"VARIANCE|STDEV|MEDIAN|PERCENTILE_CONT|PERCENTILE_DISC|COVAR_POP|COVAR_SMAP|CORR",
    "grouping": r"GROUP BY",
    "ordering": r"ORDER BY",
    "window": r"OVER",
    "top_k": r"(?d)^(?=.*ORDER BY )(?=.*LIMIT )",
    "join": r"JOIN",
    "intersect": r"INTERSECT",
    "union": r"UNION",
    "distinct": r"DISTINCT",
    "pattern_matching": r"LIKE",
    "nested": r"(?d)^(?=.*SELECT.*\(SELECT)",
}

# Workload categories tested by presence, case-insensitive.
PRESENCE_PATTERNS = {
    "selection": r"(?i)SELECT",
    "filtering": r"(?id)^(?=.*(WHERE|HAVING)(?=.*(=|>|<|IN|BETWEEN|AND|OR|NOT|LIKE)))",
    "aggregation": r"(?i)SUM|AVG|MAX|MIN",
    "counting": r"(?i)COUNT",
    "grouping": r"(?i)GROUP BY",
    "ordering": r"(?i)ORDER BY",
    "top_k": r"(?id)^(?=.*ORDER BY )(?=.*LIMIT )",
    "join": r"(?i)JOIN",
    "intersect": r"(?i)INTERSECT",
    "union": r"(?i)UNION",
    "distinct": r"(?i)DISTINCT",
    "pattern_matching": r"(?i)LIKE",
    "nested": r"(?id)^(?=.*SELECT.*\(SELECT)",
}

# Occurrence categories of the raw server log; top_k means LIMIT alone.
LOG_PATTERNS = {
    "selection": r"SELECT",
    "filtering": OCCURRENCE_PATTERNS["filtering"],
    "aggregation": r"SUM|AVG|MAX|MIN",
    "counting": r"COUNT",
    "grouping": r"GROUP BY",
    "ordering": r"ORDER BY",
    "top_k": r"LIMIT",
    "join": r"JOIN",
    "intersect": r"INTERSECT",
    "union": r"UNION",
    "distinct": r"DISTINCT",
    "pattern_matching": r"LIKE",
    "nested": OCCURRENCE_PATTERNS["nested"],
}

# Categories that make up the aggregate total of a profile.
AGGREGATE_CATEGORIES = ["min", "max", "counting", "summing", "averaging", "window", "stats", "grouping", "ordering"]

# Words a read-only workload must not hold.
WRITE_WORDS = ["UPDATE", "DELETE", "INSERT", "EXEC", "INDEX", "PRIMARY KEY", "FOREIGN KEY"]

# Columns an uploaded schema file must have.
REQUIRED_SCHEMA_COLUMNS = ["table", "columnname", "data-type", "description"]

# Semantic column classes kept by the vocabulary filter.
COLUMN_CLASSES = """
STARTDATE WEBSITE LOC1.STATE PHONE TITLE DATETIME CALL_TO_ACTION_URL DESCRIPTION LOC1.ADDRESS ENDDATE VENUE_NAME
LOC1.CITY LOC1.LON HOURS EMAIL LOC1.FULL_ADDRESS LOC1.ZIP IMAGE1 TIMERANGE LOC1.LAT PRICE_RANGE STARTTIME DATERANGE
ENDTIME REVIEWS ARTIST ENDDATETIME DURATION RATING DIRECTIONS LOC1.COUNTY STARTDATETIME TOTAL_NUMBER_OF_RATINGS
LOC1.COUNTRY
""".split()

# The text formats of prompts.
PROMPT_INSTRUCTION = "Generate SQL given the question and tables to answer the question correctly.\n\n"
PROMPT_EXAMPLE = "Question: %s \nAnswer: %s \n\n\n"
PROMPT_QUESTION = "Question: %s\nAnswer:"
EXAMPLE_BLOCK = "### Example %s:\nSQL Query:\n%s\nGold Standard NL Question:\n%s\n\n"
TABLE_DDL = "CREATE TABLE %s(\n%s\n)\n\n"
FACTS_HEAD = "*** FACTS ABOUT THE DATABASE ***\n\n"
FACT_LINE = "Fact#%s: %s \n"
LOG_HEAD = "*** ALL THE TABLES IN THE DATABASE and QUERY LOGS *** \n"
LOG_TABLE_HEAD = "\n ** PREVIOUS SQL QUERIES THAT REFERRED TO THE TABLE %s **\n"
LOG_LINE = "SQL: %s \n"

# The three questions put to a column typer, with name, values and classes.
COLUMN_HEAD = "Consider the column `%s` in the data sample below.\n%s\n\n"
COLUMN_QUESTIONS = {
    "select": "Select the class a column called `%s` with values `%s` from the list:\n\n%s\n\nReply with only one word from the list.",
    "check": "Suggest a semantic type for the column `%s` with values `%s`:\n\n%s\n\nDoes the column fit any of the possible classes? Reply \"Yes\" or \"No\".",
    "new": "Suggest a new semantic type for the column `%s` with values `%s`:\n\n%s\n\nReply with only one word: the new semantic type.",
}

# Words of SQL that are never column or table names.
RESERVED = sorted(
    {word for phrase in SQL_KEYWORDS for word in phrase.split()}
    - {"USER", "LEVEL", "PASSWORD", "LOG", "SHARE", "SESSION", "SYSTEM", "KEY", "START", "PACKAGE", "SEQUENCE"}
    | {
        "ASC", "DESC", "USING", "NATURAL", "CROSS", "LATERAL", "UNNEST", "RECURSIVE", "PRECEDING", "FOLLOWING",
        "UNBOUNDED", "CURRENT", "ROW", "FIRST", "LAST", "NULLS", "NEXT", "TRUE", "FALSE", "DATE", "TIMESTAMP", "TOP",
        "INT", "INTEGER", "BIGINT", "DOUBLE", "FLOAT", "REAL", "DECIMAL", "NUMERIC", "VARCHAR", "CHAR", "TEXT",
        "BOOLEAN", "ILIKE", "RLIKE", "REGEXP", "ESCAPE", "ANY", "SOME", "FILTER", "WITHIN", "QUALIFY", "DUAL",
    }
)
