"""Conversation repair against exhaustive search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from forecastlab.llm import repair as rp

SCHEMA = "conv_id long, turn long, role string, text string, turns string, rows long, found string, initials string, copies long, code long"
SHORT = {"system": "s", "user": "u", "assistant": "a"}


def talks(spark, rows):
    """Conversations with extra columns whose names clash with those of the operator."""
    return spark.createDataFrame([(*r, "t", 1, "f", "s", 9, 9) for r in rows], SCHEMA)


def every_repair(initials, faults, most_inserts=3):
    """(cost, audit, places and roles) of all edits that give legal turns."""
    found = []
    n = len(initials)

    def go(at, made, cost, audit, inserts):
        if at == n and re.fullmatch("(s?(ua)+)?", "".join(r for _, r in made)):
            found.append((cost, audit, tuple(made)))
        if inserts < most_inserts:
            for role in "ua":
                go(at, [*made, (-1, role)], cost + 5, audit + "I", inserts + 1)
        if at == n:
            return
        go(at + 1, made, cost + 2, audit + "D", inserts)
        if faults[at] in ("ok", "truncated"):
            more = 5 if faults[at] == "truncated" else 0
            go(at + 1, [*made, (at, initials[at])], cost + more, audit + "K", inserts)
            for role in "ua":
                go(at + 1, [*made, (at, role)], cost + 1 + more, audit + "R", inserts)

    go(0, [], 0, "", 0)
    return min(found, key=lambda f: f[:2])


KINDS = ["ok", "blank", "duplicate", "truncated"]


def test_all_short_conversations_against_every_repair():
    for n in range(3):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product(["ok", "duplicate", "truncated"], repeat=n):
                want = every_repair("".join(initials), faults)
                cost, audit, _ = rp.search("".join(initials), list(faults))
                assert (cost, audit) == want[:2], (initials, faults)
                places, roles = rp.plan("".join(initials), audit)
                assert [(p, SHORT.get(r, initials[p])) for p, r in zip(places, roles)] == list(want[2])


def test_random_conversations_against_every_repair():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(3, 5)
        initials = "".join(rng.choices("suax", [1, 4, 4, 1])[0] for _ in range(n))
        faults = [rng.choices(KINDS, [8, 1, 1, 2])[0] for _ in range(n)]
        assert rp.search(initials, faults)[:2] == every_repair(initials, faults, 2 if n > 4 else 3)[:2], (initials, faults)


def least_by_place(initials, faults):
    """The same answer by keeping the best (cost, audit) per place and state, for conversations of any length."""
    def inserted(states):
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                into = rp.NEXT[state]["a" if state == rp.USER else "u"]
                states[into] = min(states.get(into, (rp.NEVER, "")), (cost + 5, audit + "I"))
        return states

    states = inserted({rp.START: (0, "")})
    for role, fault in zip(initials, faults):
        after = {}
        for state, (cost, audit) in states.items():
            moves = [(state, cost + 2, "D")]
            if fault in ("ok", "truncated"):
                own = cost + 5 * (fault == "truncated")
                moves += [(rp.NEXT[state][role], own, "K")] if role in rp.NEXT[state] else []
                moves += [(rp.NEXT[state]["a" if state == rp.USER else "u"], own + 1, "R")]
            for into, total, name in moves:
                after[into] = min(after.get(into, (rp.NEVER, "")), (total, audit + name))
        states = inserted(after)
    return min(states[s] for s in rp.ENDS if s in states)


@pytest.mark.parametrize("letters", ["ua", "sua", "suax", "s", "u", "a"])
def test_long_conversations_open_few_nodes(letters):
    rng = random.Random(len(letters))
    initials = "".join(rng.choice(letters) for _ in range(1500))
    faults = [rng.choices(KINDS, [8, 1, 1, 2])[0] if len(letters) > 1 else "ok" for _ in initials]
    cost, audit, opened = rp.search(initials, faults)
    assert (cost, audit) == least_by_place(initials, faults)
    assert opened < 4 * len(initials)


def test_bounds_never_exceed_the_cost():
    rng = random.Random(9)
    for _ in range(200):
        initials = "".join(rng.choice("suax") for _ in range(rng.randint(0, 30)))
        faults = [rng.choice(KINDS) for _ in initials]
        assert rp.suffix_bounds(initials, faults)[0][0] <= rp.search(initials, faults)[0]


def plain(rows):
    """The contract over plain rows, repaired by :func:`least_by_place`."""
    by_id = {}
    for c, turn, role, text in rows:
        kept = by_id.setdefault(c, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    done = {}
    for c, kept in by_id.items():
        kept.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
        white, seen, faults = " \t\n\x0b\x0c\r", set(), []
        for _, role, text in kept:
            bare = text.rstrip(white)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "ok")
            seen.add((role, text))
        initials = "".join((role or " ")[0] for _, role, _ in kept)
        cost, audit = least_by_place(initials, faults)
        places, roles = rp.plan(initials, audit)
        told = "\n".join(f"{r or kept[p][1]}:{'' if p < 0 else kept[p][2]}" for p, r in zip(places, roles))
        turns = [t for t, _, _ in kept if t is not None]
        done[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1)), cost, audit, hashlib.sha256(told.encode()).hexdigest(),
        )
    return done


def odd_rows():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "Why?  \n", "日本語。", "a.b", "x.\x0b", "two\nlines.", "nbsp. ", "long words. " * 20_000]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = []
    for c in [None, *range(150)]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, rng.choices([t, None, rng.randint(-3, 9)], [6, 1, 2])[0], rng.choices(roles, [5, 5, 2, 1, 1, 1, 1])[0], rng.choice(texts)))
    rows += rows[:30] + [(900, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]
    rng.shuffle(rows)
    return rows


def test_query_against_plain_rows(spark, tmp_path):
    rows = odd_rows()
    lost = next(k for k in range(10_000, 20_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "All rows of this one are lost."))
    talks(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in rp.op13_repair(spark, str(tmp_path)).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_and_no_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Are you there?"), (2, None, "assistant", "Hello.")]
    got = {r.conv_id: r for r in rp.repair(talks(spark, rows)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "Hi."), ("assistant", "Are you there?")]
    assert (got[1].audit, got[1].cost, got[1].duplicate, got[1].illegal, got[1].gaps) == ("KDR", 3, 1, 2, 0)
    assert (got[2].audit, got[2].cost, got[2].turns) == ("D", 2, [])
    assert rp.repair(talks(spark, [])).collect() == []
