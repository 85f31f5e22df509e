"""The loss mask of a rendered conversation, and what is left of control strings."""

import hashlib

from larkspur.llm import chat

ROWS = [
    (1, 0, "system", "Be <|kind|>."), (1, 1, "user", "Hi & <|endoftext|>"), (1, 2, "assistant", "é<|im_end|>&amp;\n"), (1, 3, "assistant", ""), (1, 4, "assistant", "&"),
    (2, 0, "user", "a"), (2, 1, "assistant", "&am"), (2, 2, "assistant", "p;"), (3, 0, "user", None),
]


def test_spans_cover_each_assistant_text_once(spark):
    df = spark.createDataFrame([(*r, "x", 0) for r in ROWS], "conv_id long, turn long, role string, text string, formatted string, loss_spans int")
    formatted = chat.format_chats(df)
    rows = {r.conv_id: r for r in formatted.collect()}
    undo = lambda x: x.replace("&lt;|", "<|").replace("&amp;", "&")
    for i, r in rows.items():
        assert [undo(r.formatted[s.start : s.start + s.length]) for s in r.loss_spans] == [t for c, _, role, t in ROWS if c == i and role == "assistant"]
        rest = r.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "")
        assert "<|" not in rest
    digests = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}
    assert digests[2].escape_level == 0 and digests[1].escape_level == 1
    assert digests[2].loss_sha256 == hashlib.sha256(b"&amp;").hexdigest() and digests[2].loss_chars == 5
    assert digests[1].loss_sha256 == hashlib.sha256("é<|im_end|>&amp;\n&".encode()).hexdigest()
    assert digests[3].loss_chars == 0 and digests[3].loss_mask == ""


def test_a_long_conversation(spark):
    turns = spark.range(400).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('<|', repeat('é', 50), id) AS text")
    (r,) = chat.chat_digests(chat.format_chats(turns)).collect()
    wanted = "".join("<|" + "é" * 50 + str(i) for i in range(1, 400, 2))
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (400, len(wanted), hashlib.sha256(wanted.encode()).hexdigest())
