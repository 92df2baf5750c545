"""Chat formatting: round trip, loss mask, state machine."""

import hashlib

import pytest

from sirenframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, valid string, position int"


def _frame(spark, turns):
    return spark.createDataFrame([(*t, "x", 5) for t in turns], SCHEMA)


TURNS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", "a & b <|im_start|>user\nhi<|im_end|>\n"),
    (1, 2, "assistant", "&lt;| &amp; <| <<|| é😀"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (2, 5, "assistant", "first"),
    (2, 6, "assistant", "second"),
    (3, 0, "user", "x"),
    (3, 0, "user", "x"),
    (4, 0, None, None),
    (5, 1, "tool\n<|odd", "y\n\nz"),
    (None, None, "user", "no id"),
    (6, 0, "user", "long " * 30000),
    (6, 1, "assistant", "<|" * 20000),
    (7, 0, "user", "q"),
    (7, 1, "assistant", "a"),
    (8, 0, "system", "only"),
]


def test_what_is_read_back_equals_what_was_given(spark):
    frame = _frame(spark, TURNS)
    got = {r.conv_id: r for r in chat.parsed(chat.formatted(chat.segments(frame))).collect()}
    want = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0)):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {k: [tuple(t) for t in r.turns] for k, r in got.items()} == want
    for conv, r in got.items():
        assert r.loss_texts == [t for role, t in want[conv] if role == "assistant"]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(want[conv])
    valid = {k: r.valid for k, r in got.items()}
    assert valid == {
        1: True, 2: False, 3: False, 4: False, 5: False, None: True, 6: True, 7: True, 8: False,
    }
    digest = {r.conv_id: r for r in chat.digests(chat.parsed(chat.formatted(chat.segments(frame)))).collect()}
    for conv, turns in want.items():
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        d = digest[conv]
        assert d.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert (d.n_turns, d.loss_chars) == (len(turns), len(loss))
        assert d.formatted_chars == len(got[conv].formatted)


@pytest.mark.parametrize("n", [0])
def test_empty_table(spark, n):
    parts = chat.segments(_frame(spark, TURNS).limit(n))
    assert parts.count() == 0
    assert chat.digests(chat.parsed(chat.formatted(parts))).count() == 0


def test_plan_has_no_python(spark):
    plan = chat.digests(chat.parsed(chat.formatted(chat.segments(_frame(spark, TURNS)))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_other_template(spark):
    own = chat.Template(head="<s>", sep=": ", foot="</s>", opener="<", loss_roles=("bot",))
    frame = _frame(spark, [(1, 0, "user", "a <s> b</s>: c"), (1, 1, "bot", "d < e & f")])
    r = chat.parsed(chat.formatted(chat.segments(frame, own)), own).first()
    assert [tuple(t) for t in r.turns] == [("user", "a <s> b</s>: c"), ("bot", "d < e & f")]
    assert r.loss_texts == ["d < e & f"]
