"""Chat formatting: a state machine over roles and a declarative template."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What is written around turns, which roles are learned, and which may follow which.

    A turn is ``head + label + colon + text + end``. ``moves`` maps a state to the
    roles that may come next; the state is the role of the last turn, ``start``
    before the first. ``last`` are the roles a conversation may end with.
    """

    head: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {
        "system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    learned: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user", "tool"), "tool": ("assistant",)})
    last: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[tuple[str, str]]:
        """Control strings and what stands for them in a text; the backslash is first."""
        return [("\\", "\\s"), (self.head.rstrip(), "\\h"), (self.end.rstrip("\n"), "\\e")]


def escape(text: Column, template: Template) -> Column:
    """Afterwards no control string is left, and a backslash only begins an escape."""
    for control, code in template.controls():
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescape(text: Column, template: Template) -> Column:
    for control, code in reversed(template.controls()):
        text = F.replace(text, F.lit(code), F.lit(control))
    return text


def _label(role: Column, template: Template) -> Column:
    """The template's label; any other role is written as ``\\r`` and its escaped name."""
    known = F.create_map(*[F.lit(x) for pair in template.labels.items() for x in pair])
    other = F.concat(F.lit("\\r"), F.replace(escape(role, template), F.lit(":"), F.lit("\\c")))
    return F.coalesce(F.try_element_at(known, role), other)


def _role(label: Column, template: Template) -> Column:
    known = F.create_map(*[F.lit(x) for role, name in template.labels.items() for x in (name, role)])
    other = unescape(F.replace(F.substring(label, 3, 2**31 - 1), F.lit("\\c"), F.lit(":")), template)
    return F.coalesce(F.try_element_at(known, label), other)


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation: conv_id, segments (text, loss), formatted, valid_order.

    Turns go by ``turn``, equal ones by role and text; a null turn comes first.
    Null texts and null roles are empty strings. Conversations whose turns break
    the state machine, or have an unknown role, are formatted all the same and
    marked ``valid_order = false``. Turns with a null conv_id form one
    conversation. Repeated rows are turns of their own. A conversation is one
    output value, so it is gathered in one task and has to fit there.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    moves = F.create_map(*[x for state, following in template.moves.items() for role in following
                           for x in (F.lit(f"{state}>{role}"), F.lit(role))])
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    state = F.aggregate("turns", F.lit("start"), lambda at, t: F.coalesce(
        F.try_element_at(moves, F.concat(at, F.lit(">"), t["role"])), F.lit("wrong")))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.head), _label(t["role"], template), F.lit(template.colon)).alias("text"),
                 F.lit(False).alias("loss")),
        F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.learned).alias("loss")),
        F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))))
    return ordered.select("conv_id", segments.alias("segments"), state.isin(*template.last).alias("valid_order")).select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "valid_order")


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns (role, text) of every formatted conversation, read from its text."""
    pieces = F.split("formatted", re.escape(template.end.rstrip("\n")) + "\n")
    colon, skip = F.lit(template.colon), len(template.head) + 1
    parsed = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        _role(F.substring(F.substring_index(p, template.colon, 1), skip, 2**31 - 1), template).alias("role"),
        unescape(p.substr(F.instr(p, colon) + len(template.colon), F.length(p)), template).alias("text")))
    return formatted.withColumn("turns", parsed)


def chat_digests(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what the formatted conversations and their loss flags hold."""
    back = read_chats(format_chats(turns, template), template)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(
        F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return back.withColumn("learned", learned).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid_order")


SQL = r"""
WITH c AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, lag(role, 1, 'start') OVER w AS was, lead(role, 1, 'end') OVER w AS next,
  replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e') AS safe FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(4 + length(role) + 2 + length(safe) + 8) AS BIGINT) AS formatted_chars,
 bool_and((was || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user',
   'assistant>tool', 'tool>assistant') AND (next <> 'end' OR role = 'assistant')) AS valid_order
FROM e GROUP BY conv_id
"""
