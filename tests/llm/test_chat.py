from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from wayline.llm.chat import Template, chat_digests, escape, format_chat, parse_chat, unescape

NASTY = ["\\### Assistant: </turn> ok", "####", "\\\\h\\h\\e</turn></turn", "", "a\\", "\\", "###</turn>###", " </turn>\n### User: hi </turn>\n", "@: c", "漢😀", "x" * 100_000]
SCHEMA = "conv_id long, turn long, role string, text string, segments string, header string, piece int"


def conversation(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 1) for r in rows], SCHEMA)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or ""))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("text", NASTY)
def test_escapes_are_reversible(spark, text):
    t = Template()
    row = spark.range(1).select(escape(F.lit(text), t).alias("e")).select("e", unescape(F.col("e"), t).alias("u")).first()
    assert row.u == text and "###" not in row.e and "</turn>" not in row.e


@pytest.mark.parametrize("piece", [1, 2, 256])
def test_reads_back_what_was_told(spark, piece):
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "x"), (3, 0, None, None), (4, 0, "Narrator: @###", "t"), (5, None, "user", "q"), (5, 0, "assistant", "r"), (6, 0, "user", "same"), (6, 0, "user", "same"), (7, -300, "assistant", "late"), (7, None, "user", "first")]
    rows += [(None, 0, "user", "lost")]
    got = {r.conv_id: r for r in chat_digests(format_chat(conversation(spark, rows), piece=piece)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([x for x in rows if x[0] == c]), c
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, None: True}


def test_roles_read_back(spark):
    rows = [(1, 0, r, "t") for r in ("user", "User", "@x", "a: b", "\\@", "###")]
    out = format_chat(conversation(spark, rows)).select(parse_chat(F.col("formatted")).alias("p")).first().p
    assert sorted(x.role for x in out) == sorted(r[2] for r in rows)


def test_segments_make_up_the_text(spark):
    r = format_chat(conversation(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")])).first()
    assert "".join(s.text for s in r.segments) == r.formatted and [s.text for s in r.segments if s.loss] == ["b"]
    assert r.formatted == "### User: a </turn>\n### Assistant: b </turn>\n"


def test_empty(spark):
    assert format_chat(conversation(spark, [])).collect() == []


def test_native_plan(spark):
    plan = chat_digests(format_chat(conversation(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
