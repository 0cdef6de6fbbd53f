import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
pieces = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "#", "<", "/turn>", "a b", "é😀", "\n", "<\\/turn>", "", "### ", "<turn", "\x00"]), max_size=8).map("".join)
codec = chat.Codec(chat.vocabulary_bytes())


@settings(max_examples=200, deadline=None)
@given(pieces, pieces)
def test_round_trip(role, text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)
    ids, mask = codec.assemble(role, text, True)
    whole = chat.TURN + chat.escape(role) + chat.SAYS + escaped + chat.END
    assert codec.read(ids, mask) == (role, text, text, len(whole))
    assert codec.assemble(role, text, False)[1].sum() == 0


def test_read_back(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, "</turn>"), (None, 0, "assistant", "x")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, TURNS).withColumn("ids", chat.F.lit(1)))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (3, digest("user\na\nassistant\nb\nassistant\n\n"), 1, digest("b"))
    assert got[2]["turns_sha256"] == digest("\n</turn>\n") and got[2]["loss_chars"] == 0
    assert got[None]["loss_chars"] == 1
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], TURNS))).count() == 0


def test_long_conversations_and_texts(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} ") for i in range(3000)] + [(2, 0, "assistant", "long text " * 50_000)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, TURNS))).collect()}
    assert got[1]["n_turns"] == 3000 and got[2]["loss_chars"] == 500_000


@pytest.mark.parametrize("unit", [" ", "\n", "a", "#", "\\", "é", " \n", "</turn>"])
def test_runs_of_five_million_characters(unit):
    text = unit * (5_000_000 // len(unit)) + "x"
    ids, mask = codec.assemble("assistant", text, True)
    assert codec.read(ids, mask)[1:3] == (text, text)


def test_a_run_passes_the_operator(spark):
    rows = [(1, 0, "assistant", " " * 1_000_000), (2, 0, "user", "\n" * 1_000_000), (3, 0, "assistant", "a" * 999 + " " * 999)]
    got = {r["conv_id"]: (r["loss_chars"], r["formatted_chars"]) for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, TURNS))).collect()}
    frame = len(chat.TURN + chat.SAYS + chat.END)
    assert got == {1: (1_000_000, 1_000_009 + frame), 2: (0, 1_000_004 + frame), 3: (1998, 2007 + frame)}
