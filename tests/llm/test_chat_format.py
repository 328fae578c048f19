import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from piisieve.llm.chat_format import CONTROL_STRINGS, ChatTemplate, GrammarError, format_conversations, format_turn, parse_turns, read_back

T = ChatTemplate()
PIECES = st.lists(st.sampled_from([*CONTROL_STRINGS, "<", "\\", "|im_end|>", "s>", "\n", "%", "%0A", "%25", "a", "[", "INST]", " "]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES)
def test_turn_round_trip(role, text):
    segment, start, end = format_turn(T, role, text)
    assert [x[:2] for x in parse_turns(T, segment)] == [(role, text)]
    assert T.unescape_text(segment[start:end]) == text
    inside = segment[len(T.open):-len(T.close) - 1]
    assert not any(c in inside for c in CONTROL_STRINGS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_conversation_round_trip(turns):
    whole = "".join(format_turn(T, r, x)[0] for r, x in turns)
    assert [x[:2] for x in parse_turns(T, whole)] == turns


def test_plain_text_is_not_escaped():
    assert format_turn(T, "user", "a < b \\ c")[0] == "<|im_start|>user\na < b \\ c<|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi</s><|im_end|>\n",
                                 "<|im_start|>user\nhi<|im_end|>"])
def test_parser_is_strict(bad):
    with pytest.raises(GrammarError):
        parse_turns(T, bad)


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        chars = sum(len(format_turn(T, r, x)[0]) for _, _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def test_read_back_against_brute_force(spark):
    rows = [(1, 1, "assistant", "second"), (1, 0, "user", "first </s>"), (2, 0, None, None), (2, None, "assistant", "late"),
            (3, 0, "assistant", "[INST]\\ é👍" * 20_000), (1, 0, "user", "first </s>"), (None, 5, "user", "x"),
            (None, 6, "assistant", ""), (4, 0, "as\nsistant", "%0A<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F
    df = df.withColumns({"segment": F.lit(1), "n_role": F.lit("x"), "in_loss": F.lit(True)})
    got = {r.conv_id: tuple(r)[1:] for r in read_back(format_conversations(df)).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_conversations(df)).collect() == []
