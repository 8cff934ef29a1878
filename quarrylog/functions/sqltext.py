"""Column expressions over SQL text. No parser: patterns on cleaned text.

Unhandled forms: quoted names that hold spaces, and tables listed after a
closing sub-query parenthesis (``FROM (SELECT ..) x, t``).
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quarrylog.functions import vocab

# A quoted literal, doubled quotes included; possessive, so long text cannot overflow the matcher.
LITERAL = r"'[^']*+(?:''[^']*+)*+'"
NUMBER = r"\b[0-9]+(?:\.[0-9]+)?\b"
NAME = r"[A-Z_][A-Z0-9_$]*"
CTE_HEAD = r"(?:\bWITH|,)\s*(?:RECURSIVE\s+)?([A-Z_][A-Z0-9_$]*)\s*(?:\([^()]*\)\s*)?AS\s*(?:MATERIALIZED\s*)?\("
_STOP_WORDS = (
    "SELECT|WHERE|GROUP|ORDER|HAVING|LIMIT|UNION|INTERSECT|EXCEPT|MINUS|ON|USING|LEFT|RIGHT|FULL|INNER|OUTER|CROSS|"
    "NATURAL|LATERAL|WINDOW|FETCH|OFFSET|SET|VALUES|RETURNING|QUALIFY|FOR"
)
# A list of tables: what follows FROM and its like up to a parenthesis, the next such word or a word that ends lists.
# Letters are looked at before word ends, which cost more.
_LIST = rf"(?s)(?=[FJIU])\b(?:FROM|JOIN|INTO|UPDATE)\b(.*?)(?=[();]|(?=[A-Z])\b(?:{_STOP_WORDS}|FROM|JOIN|INTO|UPDATE)\b|\z)"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, lambdas included."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Text without white space at either end, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _if_has(text: Column, marks: list[str], changed: Column, otherwise: Column | None = None) -> Column:
    """``changed`` where ``text`` holds one of ``marks``, without which its pattern cannot match; a plain search is far cheaper."""
    return F.when(reduce(lambda a, b: a | b, [text.contains(m) for m in marks]), changed).otherwise(text if otherwise is None else otherwise)


def strip_comments(sql: Column) -> Column:
    return _if_has(sql, ["--", "/*"], F.regexp_replace(sql, rf"(?s)({LITERAL})|--[^\n]*|/\*.*?\*/", "$1"))


def mask_literals(sql: Column, mark: str = "?") -> Column:
    """every string and number becomes ``mark``; names stay."""
    return F.regexp_replace(F.regexp_replace(sql, LITERAL, mark), NUMBER, mark)


def _bare(sql: Column) -> Column:
    """Upper case, one space between words, no comments, empty literals."""
    calls = ["EXTRACT", "SUBSTRING", "TRIM", "OVERLAY", "POSITION"]
    steps = [
        lambda t: F.upper(_if_has(t, ["'"], F.regexp_replace(t, LITERAL, "''"))),
        lambda t: _if_has(t, calls, F.regexp_replace(t, rf"\b(?:{'|'.join(calls)})\s*\([^()]*\)", " ")),
        lambda t: _if_has(t, ["DISTINCT", "UPDATE"], F.regexp_replace(t, r"\bDISTINCT\s+FROM\b|\bFOR\s+UPDATE\b", " ")),
        lambda t: _if_has(t, ["  ", *"\t\n\x0b\f\r"], F.regexp_replace(t, r"\s+", " ")),
    ]
    # Every step names its text several times, so each is bound once.
    return reduce(let, steps, strip_comments(sql))


def cte_names(sql: Column) -> Column:
    """Names defined by WITH, in order, upper case."""
    return F.regexp_extract_all(_bare(sql), F.lit(CTE_HEAD), F.lit(1))


def _from_items(bare: Column) -> Column:
    """Words of every FROM/JOIN list item: ``[name, alias...]``."""
    lists = F.regexp_extract_all(bare, F.lit(_LIST), F.lit(1))
    items = F.flatten(F.transform(lists, lambda piece: F.split(piece, ",")))
    words = F.transform(items, lambda item: F.split(F.trim(F.regexp_replace(item, '["`\\[\\]]', "")), " "))
    return F.filter(words, lambda w: w[0].rlike(rf"^{NAME}(?:\.{NAME})*$"))


def table_refs(sql: Column) -> Column:
    """distinct tables after FROM / JOIN in order, qualifier dropped, CTEs excluded."""
    return let(_bare(sql), lambda bare: _tables(_from_items(bare), _ctes(bare)))


def _tables(items: Column, ctes: Column) -> Column:
    reserved = F.array(*[F.lit(w) for w in ("UNNEST", "DUAL", "TABLE")])
    return F.array_except(F.array_except(F.array_distinct(_item_names(items)), ctes), reserved)


def _found(bare: Column, marks: list[str], pattern: str) -> Column:
    """Group 1 of all matches; the text is only searched where it holds one of ``marks``."""
    nothing = F.when(bare.isNotNull(), F.array().cast("array<string>"))
    return _if_has(bare, marks, F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)), nothing)


def _ctes(bare: Column) -> Column:
    return _found(bare, ["AS (", "AS(", "MATERIALIZED"], CTE_HEAD)


def _item_names(items: Column) -> Column:
    return F.transform(items, lambda w: F.substring_index(w[0], ".", -1))


def column_refs(sql: Column) -> Column:
    """names that are no keyword, table, alias or function; qualifier dropped."""
    return let(_bare(sql), lambda bare: let(_from_items(bare), lambda items: _columns(bare, items, _ctes(bare))))


def _columns(bare: Column, items: Column, ctes: Column) -> Column:
    quotes = list('"`[]')
    text = _if_has(bare, ["("], F.regexp_replace(bare, rf"(?=[A-Z_])\b{NAME}+ ?\(", "("))
    text = let(text, lambda t: _if_has(t, ["AS "], F.regexp_replace(t, rf"\bAS {NAME}", " ")))
    text = let(text, lambda t: _if_has(t, quotes, F.regexp_replace(t, '["`\\[\\]]', "")))
    names = F.transform(F.regexp_extract_all(text, F.lit(rf"\b{NAME}(?:\.{NAME})*"), F.lit(0)), lambda n: F.substring_index(n, ".", -1))
    # The fixed words are a hash set that all rows share; only a statement's own names are made into one for it.
    names = F.filter(names, lambda n: ~n.isin(*vocab.RESERVED))
    as_names = _found(bare, ["AS "], rf"\bAS ({NAME})")
    aliases = F.flatten(F.transform(items, lambda w: F.slice(w, 2, 2)))
    return F.array_except(F.array_distinct(names), F.concat(_item_names(items), aliases, as_names, ctes))


def refs(sql: Column) -> Column:
    """F3 and F4 as a struct of ``tables`` and ``columns``, the statement cleaned once for both."""

    def both(bare: Column, bound: Column) -> Column:
        items, ctes = bound["items"], bound["ctes"]
        return F.struct(_tables(items, ctes).alias("tables"), _columns(bare, items, ctes).alias("columns"))

    return let(_bare(sql), lambda bare: let(F.struct(_from_items(bare).alias("items"), _ctes(bare).alias("ctes")), lambda b: both(bare, b)))


_SET_WORDS = {"UNION", "INTERSECT", "EXCEPT", "MINUS"}
_LIST_WORDS = {"FROM", "JOIN", "INTO", "UPDATE"}
_NO_ALIAS = {*_STOP_WORDS.split("|"), *_LIST_WORDS, "AS", "AND", "OR", "NOT", "ALL", "BY"}
_LIST_GOES_ON = set("AS ON USING AND OR NOT LEFT RIGHT FULL INNER OUTER CROSS NATURAL LATERAL".split())
_SCOPE_TOKEN = re.compile(rf"{NAME}(?:\.{NAME})*|[(),;]")


class _Scope:
    """The names that one SELECT block defines: alias -> table, or None for a CTE or a derived table."""

    def __init__(self, outer: _Scope | None):
        self.outer, self.aliases, self.ctes = outer, {}, set()

    def is_cte(self, name: str) -> bool:
        return name in self.ctes or (self.outer is not None and self.outer.is_cte(name))

    def table_of(self, qualifier: str) -> str | None:
        """The table a qualifier stands for here; an unknown one is a table's own name."""
        scope = self
        while scope is not None:
            if qualifier in scope.aliases:
                return scope.aliases[qualifier]
            scope = scope.outer
        return None if self.is_cte(qualifier) else qualifier


def scoped_columns(bare: str) -> list[dict[str, str]]:
    """``(table_name, column_name)`` of every qualified name of a statement as ``_bare`` leaves it, in order and once each.

    A parenthesis opens a scope within the one around it, a set operation a new
    scope beside the last one. A qualifier is looked up from its own scope
    outwards, so an inner alias hides an outer one. Columns of CTEs and of
    derived tables belong to no table and are left out.
    """
    tokens = _SCOPE_TOKEN.findall(bare)
    scope, stack, found = _Scope(None), [], []
    in_list = expects = False  # inside a FROM list; a table name or a derived table comes next
    for i, token in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        if token == "(":
            stack.append((scope, in_list, expects))
            scope, in_list, expects = _Scope(scope), False, False
        elif token in ");":
            if token == ")" and stack:
                scope, in_list, derived = stack.pop()
                if derived and _is_alias(alias := _alias_after(tokens, i)):
                    scope.aliases[alias] = None
            expects = False
        elif token == ",":
            expects = in_list
        elif token in _SET_WORDS:
            beside = _Scope(scope.outer)
            beside.ctes = scope.ctes
            scope, in_list, expects = beside, False, False
        elif token in _LIST_WORDS:
            in_list = expects = True
        elif expects and token not in _NO_ALIAS:
            name, alias = token.rsplit(".", 1)[-1], _alias_after(tokens, i)
            scope.aliases[alias if _is_alias(alias) else name] = None if "." not in token and scope.is_cte(name) else name
            expects = False
        elif after == "AS" and tokens[i + 2 : i + 3] == ["("] and "." not in token and token not in _NO_ALIAS:
            scope.ctes.add(token)
        elif token in _NO_ALIAS:
            in_list, expects = in_list and token in _LIST_GOES_ON, False
        elif "." in token:
            found.append((scope, *token.rsplit(".", 2)[-2:]))
    named = dict.fromkeys((table, column) for scope, qualifier, column in found if (table := scope.table_of(qualifier)) is not None)
    return [{"table_name": t, "column_name": c} for t, c in named]


def _alias_after(tokens: list[str], i: int) -> str:
    at = i + 2 if tokens[i + 1 : i + 2] == ["AS"] else i + 1
    return tokens[at] if at < len(tokens) else ""


def _is_alias(token: str) -> bool:
    return token not in _NO_ALIAS and token not in {"", "(", ")", ",", ";"} and "." not in token


_COLUMN_OWNER = T.ArrayType(T.StructType([T.StructField("table_name", T.StringType()), T.StructField("column_name", T.StringType())]))


@F.pandas_udf(_COLUMN_OWNER)
def _scoped(bare: pd.Series) -> pd.Series:
    return bare.map(lambda text: scoped_columns(text) if text is not None else [])


def owned_columns(sql: Column) -> Column:
    """``(table_name, column_name)`` of every qualified column, aliases resolved by scope."""
    return _scoped(_bare(sql))


def generalise(sql: Column) -> Column:
    """tables become ``table_k``, columns ``column_k``, literals value words; whole words only."""
    text = F.regexp_replace(F.regexp_replace(strip_comments(sql), LITERAL, "string_value"), NUMBER, "number_value")
    words = F.regexp_extract_all(text, F.lit(r"\w+|\s+|[^\w\s]"), F.lit(0))

    def renamed(bound: Column) -> Column:
        tables, columns = bound["refs"]["tables"], bound["refs"]["columns"]

        def one(word: Column) -> Column:
            table_at = F.array_position(tables, F.upper(word))
            column_at = F.array_position(columns, F.upper(word))
            return (
                F.when(table_at > 0, F.concat(F.lit("table_"), table_at.cast("string")))
                .when(column_at > 0, F.concat(F.lit("column_"), column_at.cast("string")))
                .otherwise(word)
            )

        return F.array_join(F.transform(bound["words"], one), "")

    return let(F.struct(words.alias("words"), refs(sql).alias("refs")), renamed)


def category_counts(sql: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """matches per category. A zero-width pattern counts at most once."""
    return {name: F.regexp_count(sql, F.lit(pattern)).cast("long") for name, pattern in patterns.items()}


def category_flags(sql: Column, patterns: dict[str, str]) -> dict[str, Column]:
    # find(), not matches(): rlike looks anywhere in the text.
    return {name: sql.rlike(pattern) for name, pattern in patterns.items()}


def tokens(sql: Column) -> Column:
    """words and single punctuation characters, any script."""
    return F.regexp_extract_all(sql, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def is_statement(sql: Column) -> Column:
    """P5: false for transaction noise and probes."""
    noise = [sql.startswith(word) for word in ("COMMIT", "ROLLBACK", "SET", "SELECT 1")]
    return ~reduce(lambda a, b: a | b, [*noise, sql.contains("SAVEPOINT")])


def select_count(sql: Column) -> Column:
    return F.regexp_count(sql, F.lit(r"(?i)\bSELECT\b")).cast("long")


def is_nested(sql: Column) -> Column:
    """P14."""
    return select_count(sql) >= 2


def structure(sql: Column) -> Column:
    """Q1 and A9 counts of one statement, as a struct."""
    return let(_unquoted(sql), _structure_of)


def _unquoted(sql: Column) -> Column:
    return F.regexp_replace(strip_comments(sql), LITERAL, "''")


def _structure_of(text: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in _structure_parts(text).items()])


def _structure_parts(text: Column) -> dict[str, Column]:
    def hits(pattern: str) -> Column:
        return F.regexp_count(text, F.lit("(?i)" + pattern)).cast("long")

    return {
        "num_joins": hits(r"\bJOIN\b"),
        "implicit_joins": F.size(_join_conditions(text)).cast("long"),
        "num_conditions": hits(r"<=|>=|<>|!=|=|<|>|\bLIKE\b|\bIN\b|\bBETWEEN\b"),
        "has_group_by": (hits(r"\bGROUP\s+BY\b") > 0),
        "has_order_by": (hits(r"\bORDER\s+BY\b") > 0),
        "has_having": (hits(r"\bHAVING\b") > 0),
        "has_subquery": (hits(r"\(\s*SELECT\b") > hits(r"\bAS\s*\(\s*SELECT\b")),
        "selects": hits(r"\bSELECT\b"),
        "nesting": (hits(r"\bSELECT\b") - hits(r"\b(?:INTERSECT|EXCEPT)\b")),
        "aggregates": hits(r"\b(?:SUM|AVG|MIN|MAX|COUNT)\s*\(|\bGROUP\s+BY\b"),
        "textual_aggregates": hits(r"(?:sum|avg|min|max|count) ?\(|group by|partition by"),
    }


def _join_conditions(text: Column) -> Column:
    """Comma-join equalities: conjuncts ``a.x = b.y`` between two names."""
    return F.regexp_extract_all(
        text, F.lit(r"(?i)\b(?:WHERE|AND)\s+([a-z_]\w*\.\w+\s*=\s*[a-z_]\w*\.\w+)"), F.lit(1)
    )


def difficulty(sql: Column) -> Column:
    """Q2; of the structure only what decides, and each count only where the ones before leave it open."""

    def level(text: Column) -> Column:
        parts = _structure_parts(text)
        return (
            F.when(parts["has_subquery"], "extra")
            .when((parts["num_joins"] >= 2) | parts["has_group_by"], "hard")
            .when((parts["num_joins"] == 1) | (parts["num_conditions"] > 2), "medium")
            .otherwise("easy")
        )

    return let(_unquoted(sql), level)


def sql_key(sql: Column) -> Column:
    """F28."""
    return F.sha2(sql, 256)


def limit_to_rownum(sql: Column) -> Column:
    """everything after the first LIMIT outside literals goes; its number caps a wrapped query."""
    body = F.regexp_replace(strip(sql), r";\s*$", "")
    limit = r"(?s)^((?:[^'L]++|'[^']*+'|L)*?)\bLIMIT\s+([0-9]+)"
    number = F.regexp_extract(body, limit, 2)
    return F.when(
        number != "", F.concat(F.lit("SELECT * FROM ("), F.regexp_extract(body, limit, 1), F.lit(") WHERE ROWNUM <="), number)
    ).otherwise(body)


def qualify_tables(sql: Column, names: Column, owner: str) -> Column:
    """``owner.`` before each whole-word table name that follows white space, "(" or ","."""
    return F.aggregate(
        names,
        sql,
        lambda text, name: F.regexp_replace(
            text, F.concat(F.lit(r"(?i)(?<=[\s(,])(\Q"), name, F.lit(r"\E)(?![\w.$])")), F.lit(owner + ".$1")
        ),
    )


def catalog_names(sql: Column, names: Column, db: str) -> Column:
    """F27, second form: a table name after white space, "." or "(" and before white space, "." or ")" becomes `` 'db-name'``."""
    return F.aggregate(
        names,
        sql,
        lambda text, name: F.regexp_replace(
            text, F.concat(F.lit(r"(?i)(?<=[\s.(])(\Q"), name, F.lit(r"\E)(?=[\s.)])")), F.lit(f" '{db}-$1'")
        ),
    )


def strip_fence(text: Column) -> Column:
    """fenced code loses its fences."""
    bare = strip(F.regexp_replace(strip(text), r"(?m)^```sql\s*|^```\s*|```$", ""))
    return F.when(text.startswith("```"), bare).otherwise(text)


def sanitise_quoted(sql: Column) -> Column:
    """back-quoted ``a b (c-d)`` becomes ``a_b_cd``."""
    shape = r"^([^`]+?) \(([^`]+?)\)$"

    def fixed(piece: Column, i: Column) -> Column:
        head, tail = F.regexp_extract(piece, shape, 1), F.regexp_extract(piece, shape, 2)
        joined = F.concat(
            F.replace(head, F.lit(" "), F.lit("_")), F.lit("_"), F.replace(tail, F.lit("-"), F.lit(""))
        )
        return F.when((i % 2 == 1) & (head != ""), joined).otherwise(piece)

    return F.array_join(F.transform(F.split(sql, "`"), fixed), "`")


_CTE_PART = T.ArrayType(
    T.StructType([T.StructField("title", T.StringType()), T.StructField("sql", T.StringType())])
)
def cte_bodies(sql: str) -> list[dict[str, str]]:
    """Ordered WITH bodies by balanced parentheses, and ``main``: the SELECT after the last one."""
    head = re.compile(r"(?:\bWITH(?:\s+RECURSIVE)?|,)\s*([A-Za-z_]\w*)\s*(?:\([^()]*\)\s*)?AS\s*\(", re.I)
    if not re.match(r"\s*WITH\b", sql, re.I):
        return []
    parts, at = [], 0
    match = head.match(sql, len(sql) - len(sql.lstrip()))
    while match:
        depth, quote, i = 1, False, match.end()
        while i < len(sql) and depth:
            c = sql[i]
            if c == "'":
                quote = not quote
            elif not quote:
                depth += (c == "(") - (c == ")")
            i += 1
        if depth:
            return []
        parts.append({"title": match.group(1), "sql": sql[match.end() : i - 1].strip()})
        at = i
        match = head.match(sql, at + len(sql[at:]) - len(sql[at:].lstrip()))
    main = re.search(r"\bSELECT\b", sql[at:], re.I)
    if main:
        parts.append({"title": "main", "sql": sql[at + main.start() :]})
    return parts


@F.pandas_udf(_CTE_PART)
def decompose(sql: pd.Series) -> pd.Series:
    """``(title, sql)`` of every CTE in order, then ``main``; empty without WITH."""
    return sql.map(lambda text: cte_bodies(text) if text is not None else [])


def annotate_ctes(sql: Column, notes: Column) -> Column:
    """a comment line before the name of each titled CTE; ``main`` goes after the last ``)`` before SELECT, or in front.

    ``notes`` is an ordered array of ``(title, note)``.
    """

    def one(text: Column, item: Column) -> Column:
        comment = F.concat(F.lit("-- "), item["note"], F.lit("\n"))
        before = r"(?i)^(WITH\s+|,\s*)"  # stays in front, so the result is still SQL
        head = F.concat(F.lit(r"(?i)(WITH\s+|,\s*)("), item["title"], F.lit(r"\s+AS\s*\()"))
        titled = F.concat(
            text.substr(F.lit(1), F.regexp_instr(text, head) - 1),
            F.regexp_extract(F.regexp_substr(text, head), before, 0),
            comment,
            F.regexp_replace(F.regexp_substr(text, head), before, ""),
            text.substr(F.regexp_instr(text, head) + F.length(F.regexp_substr(text, head)), F.length(text)),
        )
        tail = F.lit(r"(?is)\)\s*SELECT")
        after = F.regexp_instr(text, tail)
        main = F.when(
            after > 0,
            F.concat(text.substr(F.lit(1), after), F.lit("\n"), comment, text.substr(after + 1, F.length(text))),
        ).otherwise(F.concat(comment, text))
        return F.when(F.regexp_instr(text, head) > 0, titled).when(item["title"] == "main", main).otherwise(text)

    return F.aggregate(notes, sql, one)
