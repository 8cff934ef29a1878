"""Chat formatting by a declarative template, with DataFrame functions only.

A finite-state machine over the roles says whether the turns are in order. Each
turn gives three segments: opening mark, escaped text, closing mark; only texts
of loss roles carry the loss flag. Control strings inside texts are broken by an
escape character that doubles itself, so every mark in the output is the
template's and the texts can be read back exactly.

Defined cases: a null text or role is an empty one; a role outside the template
is written by name; rows of equal turn (and rows without turn, which come
first) are ordered by role and text; repeated rows are repeated turns. An
invalid order is flagged, not dropped. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks and loss flag per role, the state machine, and the marks of any other role."""

    opens: dict[str, str] = field(default_factory=lambda: {"system": "<s>[SYS] ", "user": "<s>[INST] ", "assistant": "<s>[OUT] "})
    closes: dict[str, str] = field(default_factory=lambda: {"system": " [/SYS]", "user": " [/INST]", "assistant": " [/OUT]"})
    loss: tuple[str, ...] = ("assistant",)
    other_open: str = "<s>[ROLE] "
    other_name_end: str = " [/ROLE] "
    end: str = "</s>"
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        marks = [*self.opens.values(), *self.closes.values(), self.other_open, self.other_name_end, self.end]
        found = {piece for mark in marks for piece in mark.replace(">", "> ").replace("[", " [").split()}
        return sorted(found, key=lambda c: (-len(c), c))


DEFAULT = Template()


def escape(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in template.controls():
        text = F.replace(text, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return text


def unescape(text: Column, template: Template) -> Column:
    for c in template.controls():
        text = F.replace(text, F.lit(c[0] + ESCAPE + c[1:]), F.lit(c))
    return F.replace(text, F.lit(ESCAPE * 2), F.lit(ESCAPE))


def _by_role(role: Column, values: dict[str, Column | str], other: Column | str) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    case = None
    for name, value in values.items():
        case = F.when(role == name, as_col(value)) if case is None else case.when(role == name, as_col(value))
    return as_col(other) if case is None else case.otherwise(as_col(other))


def _state_after(roles: Column, template: Template) -> Column:
    """The state the machine ends in; ``invalid`` once a move is missing."""
    moves = [F.lit(x) for state, to in template.moves.items() for role, then in to.items() for x in (f"{state}>{role}", then)]
    table = F.create_map(*moves)
    return F.aggregate(roles, F.lit(template.start), lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit(">"), r)), F.lit("invalid")))


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``conv_id, turn, role, text`` rows to one row per conversation.

    Returns ``conv_id``, ``valid``, ``formatted`` (the whole text) and
    ``segments`` (array of text and loss flag, which join to ``formatted``).
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments_of(t: Column) -> Column:
        role = t["role"]
        named = F.concat(F.lit(template.other_open), escape(role, template), F.lit(template.other_name_end))
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(_by_role(role, template.opens, named), F.lit(False)),
            segment(escape(t["text"], template), role.isin(*template.loss)),
            segment(F.concat(_by_role(role, template.closes, ""), F.lit(template.end)), F.lit(False)),
        )

    state = _state_after(F.transform("turns", lambda t: t["role"]), template)
    out = grouped.select("conv_id", state.isin(*template.final).alias("valid"), F.flatten(F.transform("turns", segments_of)).alias("segments"))
    return out.select("conv_id", "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The (role, text) turns that a formatted text holds."""
    parts = F.split(formatted, "\\Q" + template.end + "\\E", -1)

    def turn(part: Column) -> Column:
        name_end = F.locate(template.other_name_end, part)
        skip = len(template.other_open)
        role = unescape(F.substring(part, F.lit(skip + 1), name_end - skip - 1), template)
        body = F.substring(part, name_end + len(template.other_name_end), F.length(part))
        for name in template.opens:
            known = F.startswith(part, F.lit(template.opens[name]))
            cut = len(template.opens[name])
            inner = F.substring(part, F.lit(cut + 1), F.length(part) - cut - len(template.closes[name]))
            role, body = F.when(known, F.lit(name)).otherwise(role), F.when(known, inner).otherwise(body)
        return F.struct(role.alias("role"), unescape(body, template).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, joined without separator."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
