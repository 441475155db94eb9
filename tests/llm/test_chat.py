import hashlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from rowgate.llm import chat
from rowgate.llm.queries import TRICKY, op4_chat

SF = "/root/testdata/sf0.001"
PART = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    every = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def values(row):
    return row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256


def test_query(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role or "", r.text or ""))
    turns[-7] = [("user", TRICKY), ("assistant", TRICKY)]
    got = op4_chat(spark, SF).collect()
    assert {r.conv_id: values(r) for r in got} == {c: digests(t) for c, t in turns.items()}
    assert len(got) == len(turns) and TRICKY == chr(92) + "### Assistant: </turn> ok"


MARKS = st.one_of(st.characters(codec="utf-8"), st.sampled_from(["\\", "<", "</turn>", "<turn>", "<image/>", "\n", "</turn>\n<turn>assistant\n", "<document/>"]))


@given(st.lists(MARKS).map("".join), st.lists(MARKS).map("".join))
def test_any_text_is_read_back(role, text):
    piece = f"<turn>{chat.escape(role, role=True)}\n{chat.escape(text)}</turn>\n"
    assert chat.read_turns(piece * 2) == [(role, text)] * 2


def test_typed_parts(spark):
    parts = [
        ("text", "look: </turn> <image/>", None, None, None, None, None), ("image", None, "s3/a.png", 57, 28, None, None),
        ("audio", None, "b.wav", None, None, 2.01, None), ("document", None, None, None, None, None, 3), ("video", "no", "c", 1, 1, 1.0, 1), None, ("text", None, None, None, None, None, None), ("text", "end", None, None, None, None, None),
    ]
    rows = [(1, 0, "user", parts, "x"), (1, 1, "assistant", parts, "x"), (2, 0, "user", [], "x"), (3, 0, "user", None, None)]
    turns = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, content {PART}, piece string")
    got = {(r.conv_id, r.turn): r for r in chat.format_turns(turns, parts_col="content").collect()}
    r = got[1, 1]
    assert [(a.kind, a.reference, a.tokens) for a in r.attachments] == [("image", "s3/a.png", 3), ("audio", "b.wav", 51), ("document", None, 3072)]
    for a in r.attachments:
        assert r.piece[a.place :].startswith(f"<{a.kind}/>")
    assert r.n_tokens == 3 + 51 + 3072
    assert chat.read_turns(r.piece) == [("assistant", "look: </turn> <image/>end")]
    assert r.piece[r.loss_start : r.loss_end].endswith("end") and got[1, 0].loss_start is None
    assert chat.read_turns(got[2, 0].piece) == chat.read_turns(got[3, 0].piece) == [("user", "")]


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, None, "user", "first"), (None, 0, "assistant", "alone"), (None, 1, "assistant", "x" * 300_000), (5, 0, "assi\nstant", "a\n")]
    turns = spark.createDataFrame([(*r, "t") for r in rows], "conv_id bigint, turn bigint, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert values(got[1]) == digests([("user", "first"), ("", ""), ("user", "b"), ("user", "b")])
    assert values(got[None]) == digests([("assistant", "alone"), ("assistant", "x" * 300_000)])
    assert values(got[5]) == digests([("assi\nstant", "a\n")])
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0
