import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradus.llm.chat import PARTS, ChatTemplate, TurnReader, format_conversations, format_turn, read_back

TEMPLATE = ChatTemplate()
BITS = ["<", ">", "[", "]", "/", "\\", "s", "INST", "SYS", "<s>", "</s>", "[/INST]", "<image>", "é"]
TRICKY = st.lists(st.sampled_from(BITS), max_size=20).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "<s>"]), TRICKY), max_size=6))
def test_turns_come_back(turns):
    whole = "".join(format_turn(r, t, None, TEMPLATE)["formatted"] for r, t in turns)
    for cut in (1, 7, len(whole) + 1):
        reader = TurnReader(TEMPLATE)
        found = [x for at in range(0, len(whole), cut) for x in reader.feed(whole[at : at + cut])]
        assert found == turns and reader.rest == ""


@settings(max_examples=200, deadline=None)
@given(TRICKY)
def test_escaped_text_holds_no_control_string(text):
    escaped = TEMPLATE.escape(text)
    assert not any(c in escaped for c in TEMPLATE.controls)
    assert TEMPLATE.unescape(escaped) == text


def test_parts_become_placeholders():
    parts = [
        {"kind": "text", "text": "see <ima"},
        {"kind": "text", "text": "ge> and"},
        {"kind": "image", "uri": "a.png", "width": 29, "height": 14},
        {"kind": "audio", "uri": "b.wav", "seconds": 1.5},
        {"kind": "document", "uri": "c.pdf", "pages": 2},
        None,
    ]
    turn = format_turn("user", "unused", parts, TEMPLATE)
    assert turn["formatted"] == "[INST]see <\\image> and<image><audio><document>[/INST]"
    assert [(a["ordinal"], a["kind"], a["uri"], a["tokens"]) for a in turn["attachments"]] == [
        (0, "image", "a.png", 3),
        (1, "audio", "b.wav", 38),
        (2, "document", "c.pdf", 1024),
    ]
    assert turn["media_tokens"] == 1065
    assert TurnReader(TEMPLATE).plain(turn["formatted"][6:-7]) == "see <image> and"
    with pytest.raises(ValueError):
        format_turn("user", None, [{"kind": "video"}], TEMPLATE)


def test_overlapping_control_strings_are_refused():
    with pytest.raises(ValueError):
        ChatTemplate(frames={"user": ("<a>", ">b<")})
    with pytest.raises(ValueError):
        ChatTemplate(frames={"user": ("<s>", "<s>")})


def test_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "system", "be kind"), (1, 2, "assistant", said), (1, 1, "user", None), (1, 3, "assistant", "z" * 90_000),
        (2, 0, "user", ""), (None, 0, "user", "x"), (None, None, None, "y"), (3, 0, "user", "a"), (3, 0, "user", "a"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in read_back(format_conversations(messages)).collect()}
    order = {1: [0, 2, 1, 3], 2: [4], None: [6, 5], 3: [7, 8]}
    order[1] = [0, 2, 1, 3]
    for conv, places in order.items():
        turns = [(rows[p][2] or "", rows[p][3] or "") for p in places]
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        learnt = "".join(t for r, t in turns if r == "assistant")
        got = found[conv]
        assert (got.n_turns, got.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    clash = messages.selectExpr("*", "1 AS parts", "2 AS formatted", "3 AS loss_from")
    assert read_back(format_conversations(clash)).count() == 4
    assert read_back(format_conversations(messages.limit(0))).count() == 0


def test_typed_parts_from_a_column(spark):
    rows = [(1, 0, "user", None, [("image", None, "u", 14, 14, None, None)]), (1, 1, "assistant", "yes", None)]
    messages = spark.createDataFrame(
        rows, f"conv_id long, turn long, role string, text string, p {PARTS}"
    )
    first, second = sorted(format_conversations(messages, parts_col="p").collect(), key=lambda r: r.turn)
    assert first.formatted == "[INST]<image>[/INST]" and first.attachments[0].uri == "u"
    assert second.formatted == "<s>yes</s>" and second.formatted[second.loss_from : second.loss_to] == "yes"
