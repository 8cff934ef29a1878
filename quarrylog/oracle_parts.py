"""Pieces of DuckDB SQL shared by the SQL twins of the registered queries."""

from __future__ import annotations

from quarrylog import inputs
from quarrylog.functions import vocab

NAME = "[A-Z_][A-Z0-9_$]*"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(**parts: str) -> str:
    """WITH clause from named selects."""
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items()) + "\n"


QL = with_(query_log=inputs.QUERY_LOG_SQL)

LITERAL = "'[^']*(?:''[^']*)*'"


def replaced(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(by)}, 'g')"


def found(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {quoted(pattern)}, {group})"


def hits(expr: str, pattern: str) -> str:
    return f"CAST(len({found(expr, pattern)}) AS BIGINT)"


def masked(expr: str) -> str:
    return replaced(replaced(expr, LITERAL, "?"), r"\b[0-9]+(?:\.[0-9]+)?\b", "?")


def bare(expr: str) -> str:
    text = replaced(expr, LITERAL, "''")
    return replaced(f"upper({text})", r"\s+", " ")


_STOPS = (
    "SELECT|WHERE|GROUP|ORDER|HAVING|LIMIT|UNION|INTERSECT|EXCEPT|MINUS|ON|USING|LEFT|RIGHT|FULL|INNER|OUTER|CROSS|"
    "NATURAL|LATERAL|WINDOW|FETCH|OFFSET|SET|VALUES|RETURNING|QUALIFY|FOR"
)


def refs(source: str, sql: str, prefix: str = "", keep: str = "*") -> dict[str, str]:
    """Named selects that add ``{prefix}tabs`` and ``{prefix}cols`` to ``source``; the last is ``{prefix}refs``."""
    text = replaced(f"{prefix}bare", "[();]", "\x02")
    text = replaced(text, rf"\b(?:{_STOPS})\b", "\x02")
    text = replaced(text, r"\b(?:FROM|JOIN|INTO|UPDATE)\b", "\x02\x01")
    pieces = f"list_filter(string_split({text}, '\x02'), lambda p: starts_with(p, '\x01'))"
    items = f"flatten(list_transform({pieces}, lambda p: string_split(substr(p, 2), ',')))"
    words = f"list_transform({items}, lambda i: string_split(trim(i), ' '))"
    cols = replaced(replaced(f"{prefix}bare", rf"\b{NAME} ?\(", "("), rf"\bAS {NAME}", " ")
    cols = found(cols, rf"\b{NAME}(?:[.]{NAME})*")
    reserved = "[" + ", ".join(quoted(w) for w in vocab.RESERVED) + "]"
    p = prefix
    return {
        f"{p}refs0": f"SELECT {keep}, {bare(sql)} AS {p}bare FROM {source}",
        f"{p}refs1": f"""SELECT *, list_filter({words}, lambda w: w[1] <> '') AS {p}items,
          {found(f"{p}bare", r"(?:\bWITH|,)\s*([A-Z_][A-Z0-9_$]*)\s*AS\s*[(]", 1)} AS {p}ctes,
          {found(f"{p}bare", rf"\bAS ({NAME})", 1)} AS {p}as_names,
          list_transform({cols}, lambda n: split_part(n, '.', -1)) AS {p}names FROM {p}refs0""",
        f"{p}refs2": f"""SELECT *, flatten({p}items) AS {p}from_words,
          list_filter(list_transform({p}items, lambda w: w[1]),
            lambda t: NOT list_contains({p}ctes, t)) AS {p}all_tabs FROM {p}refs1""",
        f"{p}refs": f"""SELECT * EXCLUDE ({p}bare, {p}items, {p}ctes, {p}as_names, {p}names, {p}from_words, {p}all_tabs),
          list_filter({p}all_tabs, lambda x, i: list_position({p}all_tabs, x) = i) AS {p}tabs,
          list_filter({p}names, lambda c, i: list_position({p}names, c) = i AND NOT list_contains({p}from_words, c)
            AND NOT list_contains({p}as_names, c) AND NOT list_contains({p}ctes, c)
            AND NOT list_contains({reserved}, c)) AS {p}cols FROM {p}refs2""",
    }


def owned_columns(source: str, sql: str, key: str = "query_id") -> dict[str, str]:
    """Named selects up to ``owned_columns (key, table_name, column_name)``: qualified columns, aliases resolved by scope.

    A token's scope is the last parenthesis, or set operation, that opened at its depth.
    """
    sets, lists = "('UNION', 'INTERSECT', 'EXCEPT', 'MINUS')", "('FROM', 'JOIN', 'INTO', 'UPDATE')"
    stops = "(" + ", ".join(quoted(w) for w in [*_STOPS.split("|"), "FROM", "JOIN", "INTO", "UPDATE", "AS", "AND", "OR", "NOT", "ALL", "BY"]) + ")"
    name = f"t NOT IN {stops} AND t NOT IN ('(', ')', ',', ';')"
    here = f"PARTITION BY {key}, s ORDER BY i"
    return {
        "toks": f"SELECT {key}, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM (SELECT {key}, {found(bare(sql), rf'{NAME}(?:[.]{NAME})*|[(),;]')} AS w FROM {source})",
        "deep": f"SELECT *, sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS d FROM toks",
        "placed": f"""SELECT *, coalesce(max(CASE WHEN t = '(' OR t IN {sets} THEN i END) OVER (PARTITION BY {key}, d ORDER BY i), 0) AS s,
          coalesce(max(CASE WHEN t = '(' THEN i END) OVER (PARTITION BY {key}, d ORDER BY i), 0) AS o, lead(t) OVER (PARTITION BY {key} ORDER BY i) AS next,
          lead(t, 2) OVER (PARTITION BY {key} ORDER BY i) AS second FROM deep""",
        "scopes": f"SELECT DISTINCT p.{key}, p.s, u.s AS outer_s FROM placed p LEFT JOIN placed u ON u.{key} = p.{key} AND u.i = p.o - 1 AND p.o > 0",
        "ctes": f"SELECT {key}, s, t FROM placed WHERE next = 'AS' AND second = '(' AND {name}",
        "listed": f"""SELECT *, lag(t) OVER ({here}) AS before, CASE WHEN next = 'AS' THEN second ELSE next END AS alias,
          last_value(CASE WHEN t IN {lists} THEN true WHEN t IN {stops} AND t NOT IN ('AS', 'ON', 'USING', 'AND', 'OR', 'NOT', 'LEFT', 'RIGHT', 'FULL', 'INNER', 'OUTER', 'CROSS', 'NATURAL', 'LATERAL') THEN false END IGNORE NULLS) OVER ({here}) AS in_list FROM placed""",
        "aliases": f"""SELECT {key}, s, CASE WHEN alias IS NOT NULL AND alias NOT IN {stops} AND alias NOT IN ('(', ')', ',', ';') THEN alias ELSE split_part(t, '.', -1) END AS alias, split_part(t, '.', -1) AS table_name
          FROM listed WHERE {name} AND (before IN {lists} OR (before = ',' AND in_list))""",
        "around": f"""SELECT {key}, s, s AS a, 0 AS far FROM scopes UNION ALL SELECT c.{key}, c.s, p.outer_s, 1 FROM scopes c JOIN scopes p ON p.{key} = c.{key} AND p.s = c.s WHERE p.outer_s IS NOT NULL
          UNION ALL SELECT c.{key}, c.s, g.outer_s, 2 FROM scopes c JOIN scopes p ON p.{key} = c.{key} AND p.s = c.outer_s JOIN scopes g ON g.{key} = c.{key} AND g.s = p.s WHERE g.outer_s IS NOT NULL""",
        "qualified": f"SELECT {key}, s, i, split_part(t, '.', -2) AS alias, split_part(t, '.', -1) AS column_name FROM listed WHERE contains(t, '.') AND NOT (before IN {lists} OR (before = ',' AND in_list))",
        "owned_columns": f"""SELECT DISTINCT {key}, table_name, column_name FROM (
          SELECT q.{key}, q.column_name, coalesce(arg_min(x.table_name, r.far), any_value(q.alias)) AS table_name
          FROM qualified q JOIN around r ON r.{key} = q.{key} AND r.s = q.s LEFT JOIN aliases x ON x.{key} = q.{key} AND x.s = r.a AND x.alias = q.alias GROUP BY q.{key}, q.i, q.column_name) AS z
          WHERE NOT EXISTS (SELECT 1 FROM ctes WHERE ctes.{key} = z.{key} AND ctes.t = z.table_name)""",
    }


def tokens(expr: str) -> str:
    return found(expr, r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")


def occurrences(expr: str, name: str, pattern: str) -> str:
    """Matches of one category; look-ahead patterns count at most once."""
    if name == "filtering":
        return f"CAST(CASE WHEN regexp_matches({expr}, '(?:WHERE|HAVING).*(?:=|>|<|IN|BETWEEN|AND|OR|NOT|LIKE)') THEN 1 ELSE 0 END AS BIGINT)"
    if name == "nested":
        return f"CAST(CASE WHEN regexp_matches({expr}, 'SELECT.*[(]SELECT') THEN 1 ELSE 0 END AS BIGINT)"
    if "?=" in pattern:
        return f"CAST(CASE WHEN contains({expr}, 'ORDER BY ') AND contains({expr}, 'LIMIT ') THEN 1 ELSE 0 END AS BIGINT)"
    return hits(expr, pattern)


def score_columns(gold: str, pred: str) -> str:
    """tp/fp/fn and ratios of two list columns (precision 1 if nothing predicted, recall 0 if no gold)."""
    both = f"len(list_intersect({gold}, {pred}))"
    return f"""CAST({both} AS BIGINT) AS tp, CAST(len({pred}) - {both} AS BIGINT) AS fp,
  CAST(len({gold}) - {both} AS BIGINT) AS fn"""


RATIOS = """CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r, (fp = 0 AND fn = 0) AS acc"""
