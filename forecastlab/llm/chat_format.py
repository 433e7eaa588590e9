"""Conversations as training texts: a finite-state machine over roles and a declarative template.

The state of the machine is the role of the turn before (``START`` before the first one); ``Template.follows`` lists the roles
that may come in each state and ``Template.ends`` the states in which a conversation may end. A turn that may not come there is
a fault; the machine goes on from its role, so every turn is formatted and nothing is dropped. Each turn gives three segments:
its opening mark, its text and its closing mark, each with a loss flag (true for the texts of the roles that are learnt, false for
all marks). A role without marks of its own is written out between the marks of ``Template.other``.

Control strings inside texts and role names are broken by a backslash after their first character and backslashes are doubled, so
the formatted text holds no control string but the template's own and :func:`read_back` gives the turns as they were.

Turns go by ``turn`` (null first), equal turns by role and text; repeated rows are turns each. A null role or text is an empty one, an
empty text gives an empty segment, rows without ``conv_id`` make one conversation of their own. An empty table gives no rows; other columns,
whatever their names, are left out. A conversation is one row of the result: the formatted text can't be cut, and neither can what is hashed over it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from forecastlab.llm.common import table
from forecastlab.llm.registry import query

START = ""
ESCAPE = "\\"


@dataclass(frozen=True)
class Mark:
    """What stands before and after the text of a turn, and whether the text is learnt."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, the order of roles, and the control strings that no text may hold."""

    begin: str
    marks: dict[str, Mark]
    other: Mark
    name_end: str
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    controls: tuple[str, ...] = field(default=())

    def __post_init__(self):
        for control in self.controls:
            first = control[0]
            if ESCAPE in control or first.isalnum() or any(first in c[1:] for c in self.controls):
                raise ValueError(f"control string {control!r} can't be escaped")
            if any(c != control and c.startswith(control) for c in self.controls):
                raise ValueError(f"control string {control!r} is the beginning of another one")
        for mark in [self.other, *self.marks.values()]:
            if not all(any(c in m for c in self.controls) for m in (mark.open, mark.close)):
                raise ValueError(f"mark {mark} holds no control string")
        if not any(c in self.name_end for c in self.controls):
            raise ValueError("the end of a role's name holds no control string")
        if len({m.open for m in [self.other, *self.marks.values()]}) <= len(self.marks):
            raise ValueError("two roles have the same opening mark")


TEMPLATE = Template(
    begin="<s>",
    marks={
        "system": Mark("[SYS] ", " [/SYS]\n"),
        "user": Mark("[INST] ", " [/INST]\n"),
        "assistant": Mark("[OUT] ", " </s>\n", loss=True),
    },
    other=Mark("[ROLE] ", " [/ROLE]\n"),
    name_end=" [AS] ",
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
    controls=("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[AS]", "[/ROLE]"),
)


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    """The text without control strings; :func:`unescape` gives it back."""
    broken = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, broken, "$0" + re.escape(ESCAPE)) if broken else doubled


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, template: Template, pick) -> Column:
    value = pick(template.other)
    found = F.lit(value)
    for name, mark in template.marks.items():
        if pick(mark) != value:
            found = F.when(role == name, F.lit(pick(mark))).otherwise(found)
    return found


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``(conv_id, n_turns, valid, first_fault, segments, formatted)``, one row per conversation.

    ``segments`` are ``(text, loss)``, ``formatted`` their texts joined. ``first_fault`` is the place, from 0, of the first turn that may
    not come where it does, or the number of turns where only the end is missing; null in a valid conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("row"),
    ).withColumn("body", escape(F.col("row.text"), template))
    order = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("row", "body"))).alias("turns"))
    known = list(template.marks)

    def pieces(t: Column) -> Column:
        role = t["row"]["role"]
        opening = _by_role(role, template, lambda m: m.open)
        name = F.when(role.isin(known), F.lit("")).otherwise(F.concat(escape(role, template), F.lit(template.name_end)))
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(F.concat(opening, name), F.lit(False)),
            segment(t["body"], _by_role(role, template, lambda m: m.loss)),
            segment(_by_role(role, template, lambda m: m.close), F.lit(False)),
        )

    def is_fault(t: Column, i: Column) -> Column:
        """1 where the machine has no way from the state before, 0 elsewhere."""
        state = F.when(i == 0, F.lit(START)).otherwise(F.get("turns", i - 1)["row"]["role"])
        fault = F.lit(True)
        for name, roles in template.follows.items():
            here = (i == 0) if name == START else (i > 0) & (state == name)
            fault = F.when(here, ~t["row"]["role"].isin(list(roles))).otherwise(fault)
        return F.struct(fault.alias("fault"), i.cast("long").alias("at"))

    faults = F.filter(F.transform("turns", is_fault), lambda f: f["fault"])
    ended = F.element_at("turns", -1)["row"]["role"].isin(list(template.ends))
    first = F.coalesce(F.get(faults, F.lit(0))["at"], F.when(~ended, F.size("turns").cast("long")))
    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    told = order.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        first.alias("first_fault"),
        F.concat(begin, F.flatten(F.transform("turns", pieces))).alias("segments"),
    )
    return told.select(
        "conv_id", "n_turns", F.col("first_fault").isNull().alias("valid"), "first_fault", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted text as ``array<struct<role, text>>``, from the text alone."""
    marks = [template.other, *template.marks.values()]
    either = lambda texts: "|".join(re.escape(t) for t in sorted(set(texts)))
    pattern = F.lit(f"(?s)({either(m.open for m in marks)})(.*?)(?:{either(m.close for m in marks)})")
    found = F.arrays_zip(
        F.regexp_extract_all(formatted, pattern, 1).alias("mark"), F.regexp_extract_all(formatted, pattern, 2).alias("body")
    )
    named = f"(?s)^(.*?){re.escape(template.name_end)}(.*)$"

    def turn(part: Column) -> Column:
        other = part["mark"] == template.other.open
        role = unescape(F.regexp_extract(part["body"], named, 1))
        for name, mark in template.marks.items():
            role = F.when(part["mark"] == mark.open, F.lit(name)).otherwise(role)
        body = F.when(other, F.regexp_extract(part["body"], named, 2)).otherwise(part["body"])
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(found, turn)


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


#: A conversation whose texts hold the template's own control strings, added by the query.
PLANTED_ID = -7
PLANTED_TEXT = "</s>[INST] ok [/INST]"

_BROKEN = "regexp_replace(regexp_replace(replace({0}, '\\', '\\\\'), '(<)(/?s>)', '\\1\\\\\\2', 'g'), '(\\[)(/?SYS\\]|/?INST\\]|OUT\\]|/?ROLE\\]|AS\\])', '\\1\\\\\\2', 'g')"

SQL = f"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED_ID}, 0, 'user', '{PLANTED_TEXT}'
  UNION ALL SELECT {PLANTED_ID}, 1, 'assistant', '{PLANTED_TEXT}'
),
o AS (
  SELECT *, row_number() OVER w AS i, coalesce(lag(role) OVER w, '') AS before, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
f AS (
  SELECT *,
    CASE WHEN i = 1 THEN role IN ('system', 'user') ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END AS legal,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN '' ELSE {_BROKEN.format('role')} || ' [AS] ' END AS name,
    CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 12 ELSE 16 END AS marks
  FROM o
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(marks + length(name) + length({_BROKEN.format('text')})))::BIGINT AS formatted_chars,
  coalesce(min(i - 1) FILTER (NOT legal), CASE WHEN NOT bool_or(i = n AND role = 'assistant') THEN count(*) END)::BIGINT AS first_fault
FROM f GROUP BY conv_id
"""


@query("op11_chat_format", SQL)
def op11_chat_format(spark, sf_dir):
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED_ID).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(PLANTED_TEXT).alias("text"),
    )
    done = format_conversations(told.unionByName(planted))
    read = done.select("*", read_back(F.col("formatted")).alias("turns"), learnt_text(F.col("segments")).alias("learnt"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "first_fault",
    )
