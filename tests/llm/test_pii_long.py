"""Credentials beyond 80 characters, and those that hold a card- or phone-like run, go whole."""

import random
import string

from banderole.llm import pii

RNG = random.Random(5)


def token(n):
    return "".join(RNG.choices(string.ascii_letters + string.digits, k=n))


def test_long_and_overlapping_secrets_are_redacted_whole(spark):
    secrets = {
        1: "github_pat_" + token(22) + "_" + token(59),
        2: token(400),
        3: "eyJ" + token(700) + "9",
        4: "Ab" + token(20) + "x4111111111111111x" + token(20),
        5: "k" + token(25) + "+1555123456789" + token(25).replace("-", "a"),
    }
    docs = spark.createDataFrame([(i, f"set the api token={s} and go on") for i, s in secrets.items()] + [(9, "card 4111 1111 1111 1111 and +1 555 123 4567 stay single")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert {i: out[i] for i in secrets} == dict.fromkeys(secrets, "set the api token=[SECRET] and go on")
    assert out[9] == "card [CARD] and [PHONE] stay single"
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.report(docs).collect()}
    assert len(spans[9]) == 2 and len(set(spans[4])) == len(spans[4]) == 2


def test_long_plain_tokens_stay(spark):
    text = "see /" + "/".join(["folder"] * 20) + "12 and commit " + "0123456789abcdef" * 8 + " for more"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(docs).first()["text"] == text


def test_thousands_of_spans_in_one_text(spark):
    """Pieces between spans lie in one page of the text, in two, or far apart; spans overlap and nest."""
    words, want, at, spans = [], [], 0, []
    for i in range(3_000):
        gap = "é" * RNG.choice([1, 3, 40, 9_000 if i % 500 == 7 else 2]) + " "
        kind, match = RNG.choice([("email", f"a{i}@x.de"), ("ip", "10.0.0.7"), ("card", "4111 1111 1111 1111"), ("phone", "+1 555 123 4567")])
        words += [gap, match, " "]
        want += [gap, f"[{kind.upper()}]", " "]
        spans.append(f"{kind}:{at + len(gap)}:{at + len(gap) + len(match)}")
        at += len(gap) + len(match) + 1
    docs = spark.createDataFrame([(1, "".join(words)), (2, "x" * 5_000), (3, "")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out == {1: "".join(want), 2: "x" * 5_000, 3: ""}
    assert {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}[1] == ",".join(spans)
