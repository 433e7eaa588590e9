"""Repair of conversations: the cheapest edits that give legal turns, found by depth-first branch and bound.

Legal turns are nothing, or an optional system turn and then pairs of a user and an assistant turn. Turns are kept (0), get
another role (1) or go (2, the only way for blank and repeated ones); an empty user or assistant turn may come anywhere (5); a
truncated turn that stays costs 5 more. A node of the search is a turn to come and the state of the machine; its children are the edits in
order of their bound. The bound of the rest comes from one pass back over the turns for a machine that doesn't tell the state after a
system turn from that after an assistant turn, so it is never too high. Per node a table holds the best (cost, edits) it was reached with: a prefix that is
not better ends there. The search ends when no open prefix can beat the incumbent. Of equal costs the edits whose initials are least in ASCII win.

Spark gathers a conversation's turns into one row; Python sees only role initials, flags and hashes of its turns. The search keeps a few
hundred bytes a turn, so a conversation must fit in one task, as the text hashed over it must.

A null role or text is one space. Turns go by ``turn`` (null first), equal ones by role and text; repeated rows are turns each, so the second one is a
duplicate. Empty and blank texts are blank turns. Rows without ``conv_id`` make one conversation. An empty table gives no rows; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from forecastlab.llm.common import table
from forecastlab.llm.registry import query

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial comes, by state.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
NAMES = {"s": "system", "u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT_OFF = "ok", "blank", "duplicate", "truncated"
NEVER = 1 << 60


def turn_faults(blank: list[bool], cut: list[bool], key: list) -> list[str]:
    """The first fault of each turn; ``key`` are equal where role and text are."""
    seen: set = set()
    faults = []
    for empty, short, own in zip(blank, cut, key):
        faults.append(BLANK if empty else DUPLICATE if own in seen else CUT_OFF if short else FINE)
        seen.add(own)
    return faults


def _must(state: int) -> str:
    """The role that is given to a turn, or inserted, in a state."""
    return "a" if state == USER else "u"


def suffix_bounds(initials: str, faults: list[str]) -> list[tuple[int, int, int]]:
    """Least costs of the turns from each place on, at the start, where a user and where an assistant has to come.

    The relaxed machine may end wherever a user may come, so these never exceed the true costs.
    """
    start, user, assistant = 0, 0, INSERT  # no turn left: an open user turn needs an answer
    bounds = [(start, user, assistant)]
    for role, fault in zip(reversed(initials), reversed(faults)):
        gone = [start + DELETE, user + DELETE, assistant + DELETE]
        if fault in (FINE, CUT_OFF):
            more = TRUNCATED if fault == CUT_OFF else 0
            to_user = assistant + more + (0 if role == "u" else REROLE)
            gone[0] = min(gone[0], to_user, user + more if role == "s" else NEVER)
            gone[1] = min(gone[1], to_user)
            gone[2] = min(gone[2], user + more + (0 if role == "a" else REROLE))
        user, assistant = min(gone[1], INSERT + gone[2]), min(gone[2], INSERT + gone[1])
        start = min(gone[0], INSERT + assistant)
        bounds.append((start, user, assistant))
    bounds.reverse()
    return bounds


def _class(state: int) -> int:
    return 0 if state == START else 2 if state == USER else 1


class Path:
    """A prefix of edits; ``far`` skips back over many edits at once, so two prefixes are compared in logarithmic time."""

    __slots__ = ("before", "edit", "length", "far")

    def __init__(self, before: Path | None, edit: str):
        self.before, self.edit = before, edit
        if before is None:
            self.length, self.far = 0, self
        else:
            skip = before.far
            self.length = before.length + 1
            self.far = skip.far if before.length - skip.length == skip.length - skip.far.length else before

    def first(self, length: int) -> Path:
        path = self
        while path.length > length:
            path = path.far if path.far.length >= length else path.before
        return path


def earlier(one: Path, other: Path) -> bool:
    """Whether the edits of ``one`` come before those of ``other``."""
    shared = min(one.length, other.length)
    left, right = one.first(shared), other.first(shared)
    if left is right:
        return one.length < other.length
    while left.before is not right.before:
        left, right = (left.before, right.before) if left.far is right.far else (left.far, right.far)
    return left.edit < right.edit


def search(initials: str, faults: list[str]) -> tuple[int, str, int]:
    """``(cost, audit, nodes opened)`` of the cheapest repair, the ASCII-least one among equals."""
    n = len(initials)
    bounds = suffix_bounds(initials, faults)
    root = Path(None, "")
    table: dict[tuple[int, int], tuple[int, Path]] = {(0, START): (0, root)}
    best_cost, best_path = NEVER, None
    stack = [(0, START, 0, root)]
    opened = 0
    while stack:
        at, state, cost, path = stack.pop()
        if table[at, state][1] is not path or cost + bounds[at][_class(state)] > best_cost:
            continue  # a better prefix came here since, or the incumbent can't be reached
        opened += 1
        if at == n and state in ENDS and (cost < best_cost or cost == best_cost and earlier(path, best_path)):
            best_cost, best_path = cost, path
        edits = [("I", at, NEXT[state][_must(state)], cost + INSERT)]
        if at < n:
            edits.append(("D", at + 1, state, cost + DELETE))
            if faults[at] in (FINE, CUT_OFF):
                own = cost + (TRUNCATED if faults[at] == CUT_OFF else 0)
                kept = NEXT[state].get(initials[at])
                if kept is not None:
                    edits.append(("K", at + 1, kept, own))
                edits.append(("R", at + 1, NEXT[state][_must(state)], own + REROLE))
        ranked = sorted(((total + bounds[to][_class(into)], name, to, into, total) for name, to, into, total in edits), reverse=True)
        for bound, name, to, into, total in ranked:  # the most promising edit is pushed last and so opened first
            if bound > best_cost:
                continue
            child = Path(path, name)
            known = table.get((to, into))
            if known is not None and (known[0] < total or known[0] == total and not earlier(child, known[1])):
                continue
            table[to, into] = (total, child)
            stack.append((to, into, total, child))
    letters = []
    while best_path.before is not None:
        letters.append(best_path.edit)
        best_path = best_path.before
    return best_cost, "".join(reversed(letters)), opened


def plan(initials: str, audit: str) -> tuple[list[int], list[str]]:
    """The repaired turns: places of the turns they come from (-1: none) and their new roles (empty: the turn's own)."""
    places, roles, at, state = [], [], 0, START
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role = initials[at] if edit == "K" else _must(state)
        places.append(-1 if edit == "I" else at)
        roles.append("" if edit == "K" else NAMES[role])
        state = NEXT[state][role]
        at += edit != "I"
    return places, roles


FOUND = "cost long, audit string, places array<int>, roles array<string>, blank long, duplicate long, truncated long"


def _repairs(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for initials, blank, cut, key in batches:
        rows = []
        for roles, empty, short, own in zip(initials, blank, cut, key):
            faults = turn_faults(empty, short, own)
            first = "".join(roles)
            cost, audit, _ = search(first, faults)
            rows.append((cost, audit, *plan(first, audit), *(faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF))))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])


def _turn(columns: DataFrame) -> Column:
    blank_sign = r"[^\x20\x09-\x0D]"
    text = F.col("text")
    return F.struct(
        "turn", "role", "text",
        # A role without any character has a space as its initial, which no legal turn has.
        F.when(F.length("role") > 0, F.substring("role", 1, 1)).otherwise(F.lit(" ")).alias("initial"),
        (~text.rlike(blank_sign)).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("key"),
    )


def plain_rows(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with one space for a null role or text."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )


def repair(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per conversation: what is wrong with it, its cheapest repair and the repaired turns.

    ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns)``, where ``turns`` are ``(role, text)``. ``copies`` names a column
    with the number of times that a row counts; a conversation whose rows all count 0 times has no turns.
    """
    times = F.lit(1) if copies is None else F.col(copies).cast("int")
    rows = plain_rows(conversations) if copies is None else conversations.select("conv_id", "turn", "role", "text", copies)
    held = rows.groupBy("conv_id").agg(
        F.sort_array(F.flatten(F.collect_list(F.array_repeat(_turn(rows), times)))).alias("rows"),
        F.min(F.when(times > 0, F.col("turn"))).alias("low"),
        F.max(F.when(times > 0, F.col("turn"))).alias("high"),
    )
    each = lambda name: F.transform("rows", lambda t: t[name])
    found = held.withColumn("found", F.pandas_udf(_repairs, FOUND)(each("initial"), each("blank"), each("cut"), each("key")))
    initials = F.col("initials")
    legal_pairs = [a + b for a, b in (("s", "u"), ("u", "a"), ("a", "u"))]
    pairs = F.when(
        F.size("rows") > 1,
        F.zip_with(F.slice(initials, 1, F.size("rows") - 1), F.slice(initials, 2, F.size("rows") - 1), lambda a, b: F.concat(a, b)),
    ).otherwise(F.array().cast("array<string>"))
    distinct = F.size(F.array_distinct(F.filter(each("turn"), lambda t: t.isNotNull())))
    repaired = F.transform(
        F.arrays_zip(F.col("found.places").alias("place"), F.col("found.roles").alias("role")),
        lambda p: F.struct(
            F.when(p["role"] == "", F.get("rows", p["place"])["role"]).otherwise(p["role"]).alias("role"),
            F.when(p["place"] < 0, F.lit("")).otherwise(F.get("rows", F.greatest(p["place"], F.lit(0)))["text"]).alias("text"),
        ),
    )
    return found.withColumn("initials", each("initial")).select(
        "conv_id",
        F.coalesce(F.col("high") - F.col("low") + 1 - distinct, F.lit(0)).cast("long").alias("gaps"),
        "found.blank", "found.duplicate", "found.truncated",
        F.size(F.filter(pairs, lambda p: ~p.isin(legal_pairs))).cast("long").alias("illegal"),
        "found.cost", "found.audit",
        repaired.alias("turns"),
    )


DAMAGES = 20


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults by a hash of conversation and turn: ``(conv_id, turn, role, text, copies)``; 0 copies: the row is lost."""
    told = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = plain_rows(conversations).withColumn("code", F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % DAMAGES)
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"),
    )


def _moves() -> str:
    """All ways from one state over one row, at most two inserted turns before it, as SQL values."""
    rows = []
    for state in NEXT:
        inserted, lines, now = "", "", state
        for count in range(3):
            own = f"({state}, '{inserted}', '{lines}', {INSERT * count}"
            rows.append(f"{own}, 'D', '', {now}, {DELETE})")
            rows.append(f"{own}, 'R', '{NAMES[_must(now)]}', {NEXT[now][_must(now)]}, {REROLE})")
            rows += [f"{own}, 'K', '{role}', {into}, 0)" for role, into in NEXT[now].items()]
            inserted, lines, now = inserted + "I", lines + NAMES[_must(now)] + ":\\n", NEXT[now][_must(now)]
    return ",\n  ".join(rows)


SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS codes
),
plain AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
),
named AS (SELECT DISTINCT name FROM plain),
hashed AS (
  SELECT name, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, b: xor(h >> 8, codes[(xor(h, b) & 255) + 1]))) % {DAMAGES} AS code
  FROM named, crc
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM plain JOIN hashed USING (name)
),
placed AS (
  SELECT coalesce(conv_id, -9e18::BIGINT) AS c, turn, role, text, left(role || ' ', 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged
),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE 'ok' END AS fault,
         lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair
  FROM placed
),
facts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY c
),
moves(state, inserted, lines, ins_cost, edit, role, into_state, edit_cost) AS (VALUES
  {_moves()}
),
best AS (
  SELECT c, 0::BIGINT AS i, {START} AS state, 0 AS cost, '' AS audit, '' AS turns FROM facts
  UNION ALL
  SELECT c, i, state, cost, audit, turns FROM (
    SELECT b.c, f.i, m.into_state AS state,
           b.cost + m.ins_cost + m.edit_cost + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN {TRUNCATED} ELSE 0 END AS cost,
           b.audit || m.inserted || m.edit AS audit,
           b.turns || replace(m.lines, '\\n', chr(10)) || CASE m.edit WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE m.role || ':' || f.text || chr(10) END AS turns,
           row_number() OVER (PARTITION BY b.c, m.into_state ORDER BY b.cost + m.ins_cost + m.edit_cost + CASE WHEN f.fault = 'truncated' AND m.edit <> 'D' THEN {TRUNCATED} ELSE 0 END, b.audit || m.inserted || m.edit) AS k
    FROM best b JOIN faulty f ON f.c = b.c AND f.i = b.i + 1 JOIN moves m ON m.state = b.state
    WHERE m.edit = 'D' OR (f.fault IN ('ok', 'truncated') AND (m.edit = 'R' OR f.initial = m.role))
  ) WHERE k = 1
),
ended AS (
  SELECT b.c, cost + {INSERT} * CASE state WHEN {SYSTEM} THEN 2 WHEN {USER} THEN 1 ELSE 0 END AS cost,
         audit || CASE state WHEN {SYSTEM} THEN 'II' WHEN {USER} THEN 'I' ELSE '' END AS audit,
         turns || CASE state WHEN {SYSTEM} THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN {USER} THEN 'assistant:' || chr(10) ELSE '' END AS turns
  FROM best b JOIN facts f ON f.c = b.c AND f.n = b.i
),
chosen AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, audit) = 1)
SELECT p.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate,
       coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(left(b.turns, greatest(length(b.turns) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM plain) p
LEFT JOIN facts f ON f.c = coalesce(p.conv_id, -9e18::BIGINT) LEFT JOIN chosen b ON b.c = f.c
"""


@query("op13_repair", SQL)
def op13_repair(spark, sf_dir):
    done = repair(damage(table(spark, sf_dir, "conversations")), copies="copies")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return done.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(told, 256).alias("repaired_sha256")
    )
