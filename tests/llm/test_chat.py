from __future__ import annotations

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loadcast.llm.chat import chat_text, escaped, format_chats, read_loss, read_turns, unescaped, with_planted

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[TURN]", "[TEXT]"]
EXTRA = "pieces string, t long, at long, n_runs string"


def chats(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}")
    out = format_chats(frame).select("conv_id", "n_runs", chat_text().alias("text"), read_loss().alias("loss"), "pieces")
    return {r.conv_id: r for r in out.withColumn("turns", read_turns(F.col("text"))).collect()}


def check(spark, rows):
    got = chats(spark, rows)
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        assert got[c].loss == "".join(t[2] for t in turns if t[1] == "assistant")
        assert got[c].n_runs == sum(i == 0 or turns[i - 1][1] != t[1] for i, t in enumerate(turns))
        assert [p.text for p in got[c].pieces if p.loss].__len__() == sum(t[1] == "assistant" for t in turns)
    return got


def test_template_and_runs(spark):
    got = check(spark, [(1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d"), (2, 0, "tool", "t")])
    assert got[1].text == "<s>[SYS]be kind[/SYS][INST]a[TURN]b[/INST][OUT]c[TURN]d</s>" and got[1].n_runs == 3
    assert got[2].text == "<s>[ROLE]tool[TEXT]t[/ROLE]"


def test_awkward_rows(spark):
    rows = [(1, 2, "user", None), (1, None, "assistant", ""), (1, 2, "user", "b"), (1, 2, "assistant", "a"), (1, 2, "user", "b")]
    rows += [(None, 0, "user", "x"), (None, 1, None, "</s>"), (None, 2, "[ROLE]", "[TEXT]"), (3, 0, None, None)]
    rows += [(4, i, ("user", "assistant")[i % 3 == 1], "long [/INST] " * 500) for i in range(300)] + [(5, -1, "assistant", "only\n\\")]
    check(spark, rows)


def test_empty_table(spark):
    assert chats(spark, []) == {}


def test_planted_conversation_comes_back(spark):
    frame = with_planted(spark.createDataFrame([(1, 0, "user", "hi", "x")], "conv_id long, turn long, role string, text string, pieces string"))
    got = format_chats(frame).where("conv_id = -7").select(read_loss().alias("loss"), read_turns(chat_text()).alias("turns")).first()
    said = "</s>[INST] ok [/INST]"
    assert got.loss == said and [tuple(t) for t in got.turns] == [("user", said), ("assistant", said)]
    assert hashlib.sha256(got.loss.encode()).hexdigest()


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(
    st.sampled_from(["user", "assistant", "system", "tool", "", "<s>"]),
    st.lists(st.sampled_from([*MARKS, "[", "<", "\\", "]", ">", "/INST]", "é", "\n", "$1", "\U0001f600", "[\\INST]", "<\\\\/s>"]), max_size=8).map("".join),
), min_size=1, max_size=12))
def test_any_turns_come_back(spark, turns):
    check(spark, [(1, i, role, text) for i, (role, text) in enumerate(turns)])


def test_escape_round_trip(spark):
    texts = [m for m in MARKS] + [m[0] + "\\" * k + m[1:] for m in MARKS for k in (1, 2, 5)] + ["[[INST]", "<<s>>", "[INST", "\\[TURN]\\", "[\\TURN"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and not any(m in r.e for m in MARKS) for r in rows)
