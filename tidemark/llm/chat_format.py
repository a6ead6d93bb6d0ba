"""Chat formatting on DataFrame functions alone.

A finite-state machine over the roles checks the order of turns; a declarative
template gives each role its opening and says whether its text counts for the loss.
The output is a list of segments, each with its loss flag, whose texts joined are the
formatted conversation. Control strings inside texts get a backslash after their first
character and backslashes are doubled, which `unescape` undoes exactly.

Defined results: turns are ordered by turn number, then role, then text (nulls first);
repeated rows are repeated turns; a null role or text is empty; roles outside the
template are written with their name and make the conversation invalid; rows with a
null conversation id form one conversation; other columns are not read; a table without
rows gives none. A conversation is one output row, so it is the unit that one task holds,
and a very long text in it a few copies of itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    opening: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Openings by role; every turn closes with `end`. Roles not listed open with
    other[0] + role + other[1]."""

    roles: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("[SYS] "), "user": Turn("[INST] "), "assistant": Turn("[/INST] ", loss=True)})
    other: tuple[str, str] = ("[ROLE]", "[/ROLE] ")
    end: str = "</s>"
    #: Strings that texts must not hold unescaped, besides those above.
    reserved: tuple[str, ...] = ("<s>",)
    #: Allowed orders, (state, role) -> state; a conversation may end in `final`.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
    )
    final: frozenset[str] = frozenset({"answered"})

    @property
    def controls(self) -> list[str]:
        found = {self.end, *self.reserved, *(x.strip() for x in self.other), *(t.opening.strip() for t in self.roles.values())}
        if any("\\" in x or len(x) < 2 for x in found):
            raise ValueError("a control string has two characters at least and no backslash")
        return sorted(found, key=lambda x: (-len(x), x))


def escape(text: Column, template: Template) -> Column:
    plain = "|".join(f"(?<={re.escape(x[0])})(?={re.escape(x[1:])})" for x in template.controls)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), plain, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def valid_order(roles: Column, template: Template) -> Column:
    """Whether the machine accepts the roles."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in sorted(template.moves.items()) for x in (f"{state}\n{role}", to)])
    last = F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.element_at(moves, F.concat(s, F.lit("\n"), r)), F.lit("rejected")))
    return last.isin(*template.final)


def chat_format(rows: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, valid, segments (array of text, loss), formatted: a row per conversation."""
    template = template or Template()
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def opening(role: Column) -> Column:
        out = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1]))
        for name, t in template.roles.items():
            out = F.when(role == name, F.lit(t.opening)).otherwise(out)
        return out

    loss = [name for name, t in template.roles.items() if t.loss]
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    segments = F.flatten(
        F.transform("turns", lambda t: F.array(segment(opening(t["role"]), F.lit(False)), segment(escape(t["text"], template), t["role"].isin(*loss)), segment(F.lit(template.end), F.lit(False))))
    )
    out = whole.select(id_col, valid_order(F.transform("turns", lambda t: t["role"]), template).alias("valid"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (array of role, text) of a formatted conversation."""
    template = template or Template()

    def turn(part: Column) -> Column:
        a, b = template.other
        role = F.substring_index(F.substr(part, F.lit(len(a) + 1)), b, 1)
        text = F.substr(part, F.length(role) + len(a) + len(b) + 1)
        out = F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
        for name, t in template.roles.items():
            own = F.struct(F.lit(name).alias("role"), unescape(F.substr(part, F.lit(len(t.opening) + 1))).alias("text"))
            out = F.when(F.startswith(part, F.lit(t.opening)), own).otherwise(out)
        return out

    parts = F.split(formatted, re.escape(template.end))
    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
