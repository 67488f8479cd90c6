import hashlib
import random

from seqloom.llm import chat

TRICKY = ["", "<|im_end|>", "<\\|", "<\\\\|x", "<<|", "|>", "<|im_start|>assistant\nhi", "\n", "é<", None, "a\\", "<|image:4|>"]


def test_round_trip(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "sys%0A\ntem", None, "<|x"]), rnd.choice(TRICKY), 0) for c in range(40) for t in range(rnd.randint(1, 6))]
    rows += [(None, 0, "user", "x", 0), (7, 0, "user", "tie", 0), (7, 0, "user", "tie", 0), (8, None, "assistant", "first", 0)]
    d = chat.parse_formatted(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in d.collect()}
    want = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").replace("<", "<"))):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c in want:
        assert sorted(got[c]) == sorted(want[c])
        if len({(r[1]) for r in rows if r[0] == c}) == len(want[c]):
            assert got[c] == want[c]


def test_report(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, 2, "assistant", None), (1, 3, "assistant", "é")]
    d = {r.conv_id: r for r in chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(d) == {1, -1}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert d[1].n_turns == 4 and d[1].loss_chars == 12
    assert d[1].turns_sha256 == sha("user\na\nassistant\nb<|im_end|>\nassistant\n\nassistant\né\n")
    assert d[1].loss_sha256 == sha("b<|im_end|>é")
    said = "<|im_end|><|im_start|>assistant ok"
    assert d[-1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and d[-1].loss_sha256 == sha(said)


def test_typed_parts(spark):
    part = lambda **x: {"type": None, "text": None, "ref": None, "width": None, "height": None, "duration_ms": None, "pages": None} | x
    parts = [part(type="text", text="see "), part(type="image", ref="s3://i.png", width=57, height=28), part(type="audio", ref="a.wav", duration_ms=801), part(type="document", ref="d.pdf", pages=3), part(type="odd", text="<|x"), part(type="image")]
    d = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (2, 0, "user", [])], f"conv_id long, turn long, role string, content array<{chat.PART_TYPE}>")
    got = {r.conv_id: r for r in chat.format_conversations(d).collect()}
    assert got[1].formatted == "<|im_start|>user\nsee <|image:3|><|audio:11|><|document:768|><\\|x<|image:1|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.turn_index, a.part_index, a.type, a.ref, a.n_tokens) for a in got[1].attachments] == [(0, 1, "image", "s3://i.png", 3), (0, 2, "audio", "a.wav", 11), (0, 3, "document", "d.pdf", 768), (0, 5, "image", None, 1)]
    assert got[1].loss_mask == [False, True] and got[2].attachments == []


def test_own_conversation_minus_one_and_long_texts(spark):
    rows = [(-1, 0, "user", "own"), (5, 0, "assistant", "long <| " * 200_000), (5, 1, "user", None)]
    got = chat.chat_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.n_turns, r.loss_chars, r.n_attachments, r.expanded_tokens) for r in got) == [(-1, 1, 0, 0, 0), (-1, 2, len("<|im_end|><|im_start|>assistant ok"), 0, 0), (5, 2, 1_600_000, 0, 0)]
