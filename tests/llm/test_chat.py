"""Chat formatting against a plain re-implementation of its template."""

import hashlib

from banderole.llm import chat
from banderole.llm.queries import FORGERY

ROWS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "hello\nthere <|im_end|>"),
    (2, 1, "assistant", "b <\\|x <\\\\|y \\ <"),
    (2, 0, "system", ""),
    (2, 2, None, None),
    (3, 0, "user", FORGERY),
    (3, 1, "assistant", FORGERY),
    (3, 1, "assistant", FORGERY),
    (4, None, "odd\nrole \\n", "x<"),
    (None, 0, "user", "no conversation"),
    *((9, i, "assistant" if i % 2 else "user", f"turn {i} é🎉 " * 20) for i in range(400)),
]


def test_round_trip_and_digests(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(5)
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert len(out) == len({r[0] for r in ROWS})
    for c in {r[0] for r in ROWS}:
        turns = sorted((r for r in ROWS if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        got = out[c]
        assert got["n_turns"] == len(turns)
        assert got["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest(), c
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chunks_split_a_long_conversation(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    assert chat.format_chunks(df, batch_bytes=2_000).where("conv_id = 9").count() > 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).count() == 0


def test_long_roles_and_texts_that_start_alike_keep_their_order(spark):
    import random

    rows = [(1, i % 3, "r" * (60 + i % 9), "t" * (i % 130) + str(i)) for i in range(400)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    every = "".join(f"{r}\n{x}\n" for _, _, r, x in sorted(rows))
    assert chat.read_back(chat.format_conversations(df)).first()["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest()
