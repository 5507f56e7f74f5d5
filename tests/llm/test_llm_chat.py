import hashlib
import random

import pytest

from riskbook.llm import chat
from riskbook.llm.chat import Part

SIGNS = ["<", "s", ">", "/", "[", "INST", "]", "\\", "image:1", "\n", "a", "</s>", "[INST]", "<s>", "[/INST]", "<image:0>", "é"]


def test_any_text_comes_back():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 9)))
        role = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 3)))
        assert chat.unescape(chat.escape(text)) == text
        turn = chat.format_turn(role, [Part("text", text[:3]), Part("text", text[3:])])
        assert list(chat.read_turns(turn.formatted * 2)) == [(role, text)] * 2


def test_parts_become_placeholders():
    parts = [
        Part("text", "see <image:0> "), Part("image", reference="a.png", width=100, height=60),
        Part("audio", reference="b.wav", seconds=2.0), Part("document", reference="c.pdf", pages=3), Part("text", "</s>"),
    ]
    turn = chat.format_turn("assistant", parts)
    assert turn.formatted == "<s>[INST]assistant[/INST]see <\\image:0> <image:0><audio:1><document:2><\\/s></s>"
    assert [(a.number, a.kind, a.reference, a.tokens) for a in turn.attachments] == [
        (0, "image", "a.png", 12), (1, "audio", "b.wav", 25), (2, "document", "c.pdf", 1536)
    ]
    start, end = turn.loss
    assert chat.unescape(turn.formatted[start:end]) == "see <image:0> <image:0><audio:1><document:2></s>"
    assert chat.format_turn("user", parts).loss[0] == chat.format_turn("user", parts).loss[1]


def test_unknown_parts_and_broken_texts_are_errors():
    with pytest.raises(ValueError):
        chat.format_turn("user", [Part("video")])
    with pytest.raises(ValueError):
        list(chat.read_turns("<s>[INST]user[/INST]a</s>b"))


def expected(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(frame):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (1, 2, "assistant", "é中"),
        (2, 0, None, "x" * 300_000), (None, 5, "assistant", "lost"), (3, None, "user", "a"), (3, 0, "assistant", ""),
        (4, 0, "assistant", "twice"), (4, 0, "assistant", "twice"),
    ]
    table = frame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    typed = table.withColumn("parts", chat.text_parts())
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(typed)).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    for conv, row in found.items():
        turns = [(t, r, x) for c, t, r, x in rows if c == conv]
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == expected(turns)


def test_attachments_are_counted(frame):
    part = "struct<kind:string,text:string,reference:string,width:int,height:int,seconds:double,pages:int>"
    table = frame(
        [(1, 0, "user", [("text", "a", None, None, None, None, None), ("image", None, "x", 28, 56, None, None)]), (1, 1, "user", None)],
        f"conv_id long, turn long, role string, parts array<{part}>",
    )
    row = chat.read_back(chat.format_turns(table)).first()
    assert (row["n_attachments"], row["attachment_tokens"], row["n_turns"]) == (1, 2, 2)


def test_empty_table(frame):
    typed = frame([], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts())
    assert chat.read_back(chat.format_turns(typed)).collect() == []


def test_ties_go_by_the_texts_before_escaping(frame):
    texts = ["<s>", "<a", "<\\s>", "[INST]", "[A", "a", "aA", "a<", "[\\/INST]", "", "<image:1>", "<j"]
    rows = [(1, 0, "user", x) for x in texts] + [(1, 0, None, "z"), (1, 0, "", "y"), (1, 0, "assistant", "<s>"), (1, 0, "assistant", "<t")]
    typed = frame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts())
    row = chat.read_back(chat.format_turns(typed)).first()
    ordered = sorted(rows, key=lambda r: ((r[2] or "").encode(), r[3].encode()))
    turns = "".join(f"{r[2] or ''}\n{r[3]}\n" for r in ordered)
    assert row["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
