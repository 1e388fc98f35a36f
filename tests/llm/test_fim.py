"""Fill-in-middle against a plain re-implementation."""

import hashlib

import pytest

from banderole.llm import fim
from pyspark.sql import functions as F

TEXTS = [
    None, "", "a", "ab\n", "héllo 日本語 🎉 é", "<P> inside", "a <S>", "<M>", "almost <P <S <M >", ">S><", "<" * 500, "\r\n\x00  x" * 40,
    *(f"text {i} with ünicode 🎉 " * (i % 7) + "<" * (i % 3) for i in range(300)), "é🎉" * 3_000, "w " * 1_000_000,
]
ROWS = [(i * 7919 - 3, t, "x") for i, t in enumerate(TEXTS)] + [(5, "twice the same row", "x"), (5, "twice the same row", "y"), (None, "no key", "x")]
SCHEMA = "doc_id long, text string, n string"


def brute(key, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_rows_of_brute_force_and_exact_inverse(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(k), *brute(k, t), t or "") for k, t, _ in ROWS)
    got = sorted((str(r["key"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert got == want
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 2, 64])
@pytest.mark.parametrize("segment", [64, 128])
def test_cutter_counts_and_cuts_by_offsets(block, segment):
    cut = fim.Cutter(block, segment)
    for text in ("", "a", "x" * 63, "é" * 64, "🎉\n" * 100, "\r\n" * 64):
        assert cut.length(text) == len(text)
        assert [cut.offset(text, k, len(text)) for k in range(len(text) + 1)] == list(range(len(text) + 1))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert fim.transform(df).count() == 0
