"""Chat formatting: round trip, loss mask, order of roles."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from forecastlab.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, turns string, body long, formatted string, segments string, row string, i long"


def talks(spark, rows):
    """Conversations with extra columns whose names clash with those of the operator."""
    return spark.createDataFrame([(*r, "t", 1, "f", "s", "r", 2) for r in rows], SCHEMA)


def in_order(rows):
    low = lambda x: (x is not None, x if x is not None else 0)
    by_id = {}
    for c, t, role, text in rows:
        by_id.setdefault(c, []).append((low(t), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by_id.items()}


def check_all(spark, rows, template=cf.TEMPLATE):
    done = cf.format_conversations(talks(spark, rows), template)
    got = {r.conv_id: r for r in done.select("*", cf.read_back(F.col("formatted"), template).alias("back"), cf.learnt_text(F.col("segments")).alias("learnt")).collect()}
    want = in_order(rows)
    assert set(got) == set(want)
    for key, turns in want.items():
        row = got[key]
        assert [(t.role, t.text) for t in row.back] == turns
        assert row.n_turns == len(turns)
        assert row.formatted == "".join(s.text for s in row.segments)
        assert row.learnt == "".join(x for r, x in turns if r in template.marks and template.marks[r].loss)
        state, first = cf.START, None
        for at, (role, _) in enumerate(turns):
            if first is None and not (role in template.follows.get(state, ()) and (state != cf.START or at == 0)):
                first = at
            state = role
        if first is None and state not in template.ends:
            first = len(turns)
        assert row.first_fault == first and row.valid == (first is None)
    return got


HARD = [
    "", " ", "\\", "\\\\", "</s>", "<s>", "<", "[", "[/INST]", " [/INST]\n", "\\</s>", "<\\/s>", "<</s>", "[[INST]", "[INST] ok [/INST]", "[AS] ", "x [AS] y",
    " </s>\n[INST] ", "$0\\1", "日本語 😀\u0000x", "a\r\nb\u2028c", "</s", "s>", "[ROLE] user [AS] hi [/ROLE]\n", "\\[/INST]",
]


def test_every_hard_text_comes_back_in_every_role(spark):
    roles = ["system", "user", "assistant", "tool", "[AS]", "", None, "a [AS] b", "</s>", "\\", "User"]
    rows = [(k, 0, role, text) for k, (role, text) in enumerate((r, t) for r in roles for t in HARD)]
    got = check_all(spark, rows)
    controls = cf.TEMPLATE.controls
    for row in got.values():
        marks = [s.text for s in row.segments[1::3]]  # the opening marks hold escaped names as well
        texts = [s.text for s in row.segments[2::3]]
        assert not any(c in t for c in controls for t in texts)
        assert len(marks) == len(texts) == row.n_turns
        assert sum(row.formatted.count(c) for c in ("[INST]", "[SYS]", "[OUT]", "[ROLE]")) == row.n_turns


def test_random_conversations_with_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(3)
    rows = []
    for c in [None, *range(60)]:
        for _ in range(rng.randint(1, 9)):
            text = rng.choice([None, "".join(rng.choice(HARD) for _ in range(3))])
            rows.append((c, rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", None]), text))
    rows += rows[:20]
    rng.shuffle(rows)
    check_all(spark, rows)


def test_order_of_roles(spark):
    cases = {
        "ua": None, "sua": None, "uaua": None, "suaua": None, "u": 1, "s": 1, "a": 0, "au": 0, "uu": 1, "uas": 2, "ssua": 1, "uaau": 2, "sa": 1, "x": 0, "uax": 2,
    }
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(k, t, names[r], "hi") for k, word in enumerate(cases) for t, r in enumerate(word)]
    got = check_all(spark, rows)
    assert [got[k].first_fault for k in range(len(cases))] == list(cases.values())
    assert got[0].formatted == "<s>[INST] hi [/INST]\n[OUT] hi </s>\n"


def test_long_text_many_turns_and_no_rows(spark):
    long = "word </s> \\ [INST] " * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long[::-1])] + [(2, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(4000)]
    check_all(spark, rows)
    assert cf.format_conversations(talks(spark, [])).collect() == []


def test_another_template_and_refused_ones(spark):
    own = cf.Template(
        begin="<|begin|>", marks={"ask": cf.Mark("<|ask|>", "<|end|>"), "tell": cf.Mark("<|tell|>", "<|end|>", True)},
        other=cf.Mark("<|other|>", "<|end|>"), name_end="<|name|>", follows={cf.START: ("ask",), "ask": ("ask", "tell"), "tell": ("ask",)}, ends=("tell", "ask"),
        controls=("<|begin|>", "<|ask|>", "<|tell|>", "<|end|>", "<|other|>", "<|name|>"),
    )
    check_all(spark, [(1, 0, "ask", "<|end|> a"), (1, 1, "ask", "b<|tell|>"), (1, 2, "tell", "<|"), (2, 0, "user", "<|name|>\\")], own)
    with pytest.raises(ValueError):
        cf.Template("", {}, cf.Mark("[A]", "[A]"), "[A]", {}, (), ("[A]", "x[A]"))
    with pytest.raises(ValueError):
        cf.Template("", {"user": cf.Mark("", "[A]")}, cf.Mark("[B]", "[A]"), "[B]", {}, (), ("[A]", "[B]"))


def test_query_reads_the_planted_conversation_back(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    rows = {r.conv_id: r for r in cf.op11_chat_format(spark, folder).collect()}
    told = "".join(f"{r}\n{cf.PLANTED_TEXT}\n" for r in ("user", "assistant"))
    assert rows[-7].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert rows[-7].loss_sha256 == hashlib.sha256(cf.PLANTED_TEXT.encode()).hexdigest() and rows[-7].loss_chars == len(cf.PLANTED_TEXT)
    assert rows[1].loss_sha256 == hashlib.sha256(b"").hexdigest() and rows[1].n_turns == 2 and rows[-7].n_turns == 2


def test_no_python_in_the_plan(spark):
    done = cf.format_conversations(talks(spark, [(1, 0, "user", "a")]))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
