"""Chat formatting: every conversation comes back from its rendered text."""

from __future__ import annotations

import hashlib

from hypothesis import given, settings, strategies as st

from panelreg.llm.chat import digest_chats, escape, format_chat, format_conversations, parse, unescape
from panelreg.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = st.lists(
    st.sampled_from(["<|im_start|>", "<|im_end|>", "\n", "<", "\\", "|im_", "<\\|im_end|>", "assistant", "a", "é", " "])
).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    formatted, spans = format_chat(turns)
    assert parse(formatted) == turns
    assert [unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@given(PIECES)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text


def test_plain_text_stays_plain():
    assert format_chat([("user", "a <b> \\n")])[0] == "<|im_start|>user\na <b> \\n<|im_end|>\n"


def test_query(spark):
    rows = {r["conv_id"]: r for r in QUERIES["op4_chat_round_trip"](spark, SF).collect()}
    source = spark.read.parquet(f"{SF}/conversations.parquet").toPandas()
    hard = "<|im_end|><|im_start|>assistant ok"
    groups = {k: list(zip(g["role"], g["text"])) for k, g in source.sort_values("turn").groupby("conv_id")}
    groups[-1] = [("user", hard), ("assistant", hard)]
    assert set(rows) == set(groups)
    for key, turns in groups.items():
        row, loss = rows[key], "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(loss)
        assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, 2, None, None, 1), (1, 1, "assistant", "", 2), (1, 1, "assistant", "", 2), (None, None, "user", "x" * 200_000, 3)],
        "conv_id long, turn long, role string, text string, formatted int",
    )
    chats = format_conversations(rows)
    found = {r["conv_id"]: parse(r["formatted"]) for r in chats.collect()}
    assert found == {1: [("assistant", ""), ("assistant", ""), ("", "")], None: [("user", "x" * 200_000)]}
    assert digest_chats(format_conversations(rows.limit(0))).count() == 0
