"""Prompt text assembled from schemas, examples and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylog.functions import vocab
from quarrylog.operators.joins import first_per_group, spread_join
from quarrylog.operators.sequence import ordered, with_running_sum


def table_ddl(columns: DataFrame, keys: bool = True) -> DataFrame:
    """CREATE TABLE text per table: columns in order, primary keys (last first), foreign keys."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type", "pkey", "fkey")))
    grouped = columns.groupBy("db_id", "table_name").agg(ordered.alias("c"))
    lines = F.transform("c", lambda c: F.concat(F.lit("  "), c["column_name"], F.lit(" "), c["data_type"]))
    primary = F.transform(
        F.reverse(F.filter("c", lambda c: c["pkey"] == "PRIMARY KEY")),
        lambda c: F.concat(F.lit("  PRIMARY KEY ("), c["column_name"], F.lit(")")),
    )
    foreign = F.transform(
        F.filter("c", lambda c: c["fkey"].contains("FOREIGN KEY")),
        lambda c: F.concat(F.lit("  FOREIGN KEY("), c["column_name"], F.lit(")"), F.substring(c["fkey"], 12, 1 << 30)),
    )
    body = F.concat(lines, primary, foreign) if keys else lines
    text = F.format_string(vocab.TABLE_DDL, "table_name", F.array_join(body, ",\n"))
    return grouped.select("db_id", "table_name", text.alias("ddl"))


def flat_catalog(columns: DataFrame) -> DataFrame:
    """One ``TABLE,col1,...`` text per table."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "column_name")))
    grouped = columns.groupBy("db_id", "table_name").agg(ordered.alias("c"))
    schema = F.concat_ws(",", F.concat_ws("-", F.upper("db_id"), F.upper("table_name")), F.col("c.column_name"))
    return grouped.select("db_id", "table_name", schema.alias("schema"))


def example_block(examples: Column) -> Column:
    """numbered SQL and question text; ``examples`` is an ordered array of ``(sql, question)``."""
    blocks = F.transform(examples, lambda e, i: F.format_string(vocab.EXAMPLE_BLOCK, i, e["sql"], e["question"]))
    return F.array_join(blocks, "")


def question_prompt(examples: Column, ddl: Column, question: Column) -> Column:
    """instruction, solved examples, table definitions, question."""
    solved = F.transform(examples, lambda e: F.format_string(vocab.PROMPT_EXAMPLE, e["question"], e["sql"]))

    def section(texts: Column) -> Column:
        return F.when(F.size(texts) > 0, F.concat(F.array_join(texts, ""), F.lit("\n"))).otherwise("")

    return F.concat(
        F.lit(vocab.PROMPT_INSTRUCTION), section(solved), section(ddl), F.format_string(vocab.PROMPT_QUESTION, question)
    )


def log_prompt(ddl: DataFrame, log: DataFrame, scope: str, facts: list[str] = ()) -> DataFrame:
    """F23, log and fact variants: per scope its facts, then every table with the earlier queries chosen for it.

    ``ddl`` is ``(scope, table_name, ddl)``, ``log`` is ``(scope, table_name,
    rank, sql)`` as ``table_log`` cuts it.
    """
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "sql"))), lambda q: F.format_string(vocab.LOG_LINE, q["sql"])
    )
    logged = log.groupBy(scope, "table_name").agg(F.array_join(lines, "").alias("lines"))
    section = F.concat(
        F.regexp_replace("ddl", r"\n\n$", "\n"),
        F.when(
            F.col("lines").isNotNull(), F.concat(F.format_string(vocab.LOG_TABLE_HEAD, "table_name"), F.col("lines"))
        ).otherwise(""),
        F.lit("\n"),
    )
    sections = ddl.join(logged, [scope, "table_name"], "left").select(scope, "table_name", section.alias("section"))
    ordered_sections = F.array_sort(F.collect_list(F.struct("table_name", "section")))
    head = "".join(vocab.FACT_LINE % (i, fact) for i, fact in enumerate(facts, 1))
    head = (vocab.FACTS_HEAD + head + "\n" if facts else "") + vocab.LOG_HEAD
    texts = F.array_join(F.transform(ordered_sections, lambda t: t["section"]), "")
    return sections.groupBy(scope).agg(F.concat(F.lit(head), texts).alias("prompt"))


def prompts(
    questions: DataFrame, examples: DataFrame, ranked_tables: DataFrame, ddl: DataFrame, key: str, group: str, m: int, k: int
) -> DataFrame:
    """L4: one prompt per question.

    ``examples`` is ``(group, example, sql, question)``: the first ``m`` others
    of the question's group are shown. ``ranked_tables`` is ``(group, rank,
    table_name)``. Both lists are short and are joined as arrays.
    """
    heads = first_per_group(examples, [group], ["example"], m + 1, "pos")
    lists = heads.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct("pos", "example", "sql", "question"))).alias("heads")
    )
    chosen = ranked_tables.where(F.col("rank") <= k).join(ddl.select("table_name", "ddl"), "table_name")
    texts = chosen.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ddl"))), lambda t: t["ddl"]).alias("ddl")
    )
    dims = lists.join(texts, group, "left")
    joined = spread_join(questions, dims, [group], [key], "left")
    others = F.slice(
        F.filter(F.coalesce("heads", F.expr("CAST(array() AS array<struct<pos:int,example:bigint,sql:string,question:string>>)")), lambda e: e["example"] != F.col(key)), 1, m
    )
    shown = F.coalesce("ddl", F.expr("CAST(array() AS array<string>)"))
    return joined.select(key, question_prompt(others, shown, F.col("question")).alias("prompt"))


def fixed_width(rows: DataFrame, key: str, headers: list[str], order: list[str], n: int = 5) -> DataFrame:
    """per key a header line, a rule and the first ``n`` rows, cells padded to the widest of their column."""
    top = first_per_group(rows, [key], order, n, "_rank")
    cells = F.array(*[F.coalesce(F.col(h).cast("string"), F.lit("None")) for h in headers])
    grouped = top.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_rank", cells.alias("cells")))).alias("r"),
        F.array(*[F.greatest(F.lit(len(h)), F.max(F.length(F.coalesce(F.col(h).cast("string"), F.lit("None"))))) for h in headers]).alias("w"),
    )

    def line(values: Column) -> Column:
        return F.array_join(F.zip_with(values, F.col("w"), lambda v, w: F.rpad(v, w, " ")), " | ")

    rule = F.repeat(F.lit("-"), (F.aggregate("w", F.lit(0), lambda a, w: a + w) + 3 * (len(headers) - 1)).cast("int"))
    lines = F.concat(
        F.array(line(F.array(*[F.lit(h) for h in headers])), rule), F.transform("r", lambda r: line(r["cells"]))
    )
    return grouped.select(key, F.array_join(lines, "\n").alias("text"))


def column_samples(cells: DataFrame, table: str, column: str, pos: str, value: str, n: int = 3) -> DataFrame:
    """Per column its first ``n`` values and first ``n`` distinct values, long form in, lists out."""
    short = cells.withColumn("_v", F.substring(F.col(value).cast("string"), 1, 25))
    first_rows = first_per_group(short, [table, column], [pos, value], n, "_rank").groupBy(table, column).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_v"))), lambda r: r["_v"]).alias("sample")
    )
    firsts = cells.groupBy(table, column, value).agg(F.min(pos).alias("_first"))
    distinct = first_per_group(firsts, [table, column], ["_first", value], n, "_rank").groupBy(table, column).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(value).cast("string").alias("v")))), lambda r: r["v"]).alias("distinct_values")
    )
    return first_rows.join(distinct, [table, column])


def column_question(form: str, column: Column, sample: Column, values: Column, classes: Column) -> Column:
    """The three question forms put to a column typer."""
    head = F.format_string(vocab.COLUMN_HEAD, column, F.array_join(sample, "\n"))
    ask = F.format_string(vocab.COLUMN_QUESTIONS[form], column, F.array_join(values, ", "), F.array_join(classes, ", "))
    return F.concat(head, ask)


def column_questions(column: Column, sample: Column, values: Column, classes: Column) -> Column:
    """All question forms as an array of ``(form, question)``."""
    asked = [(form, column_question(form, column, sample, values, classes)) for form in vocab.COLUMN_QUESTIONS]
    return F.array(*[F.struct(F.lit(form).alias("form"), question.alias("question")) for form, question in asked])


def growing_labels(predictions: DataFrame, order: str, label: str, start: list[str]) -> DataFrame:
    """C4: known labels before each prediction, as a count, and whether this one is new.

    A label is new where it is seen first and was not among the given ones.
    """
    # First sighting by aggregation, not by a window over a frequent label.
    firsts = predictions.groupBy(label).agg(F.min(order).alias(order)).withColumn("_new", ~F.col(label).isin(start))
    marked = predictions.join(firsts, [label, order], "left")
    seq = ordered(marked.select(order, label, F.coalesce("_new", F.lit(False)).alias("new_class")), [order])
    summed = with_running_sum(seq, F.col("new_class").cast("long"), "_n")
    return summed.select(order, label, "new_class", (F.col("_n") + len(start)).alias("known_classes"))
