"""A long conversation stays in chunks and is digested over them."""

import hashlib

from banderole.llm import chat


def test_no_cell_holds_a_long_conversation(spark):
    rows = [(c, i, "assistant" if i % 2 else "user", f"turn {i} é <|x") for c in (None, 7) for i in range(3000)] + [(8, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df, batch_bytes=4_000)
    assert max(len(r["formatted"]) for r in made.collect()) < 12_000
    out = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert set(out) == {None, 7, 8} and out[8]["n_turns"] == 1
    for c in (None, 7):
        loss = "".join(r[3] for r in rows if r[0] == c and r[2] == "assistant")
        every = "".join(f"{r[2]}\n{r[3]}\n" for r in rows if r[0] == c)
        assert (out[c]["n_turns"], out[c]["turns_sha256"]) == (3000, hashlib.sha256(every.encode()).hexdigest())
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
