"""Blocks under headings, carried labels, picks by rules."""

from banderole.operators import sections
from pyspark.sql import functions as F


def test_blocks_end_for_a_reason(spark):
    text = "lead\n# a\none\ntwo\n# b\n# c\r\nx\nSTOP\nstray\n# d\n" + "long\n" * 50 + "STOP\n# e\nlast"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "# only", "x"), (5, "none here", "x")], "id int, text string, start string")
    df = df.drop("start")
    got = {(r["id"], r["start"]): (r["how"], list(r["lines"])) for r in sections.blocks(df, "^# ", end="^STOP", most=10).collect()}
    assert got == {
        (1, 1): ("heading", ["# a", "one", "two"]), (1, 4): ("heading", ["# b"]), (1, 5): ("terminator", ["# c", "x"]), (1, 9): ("limit", ["# d"] + ["long"] * 9), (1, 61): ("end", ["# e", "last"]), (4, 0): ("end", ["# only"]),
    }
    whole = {r["start"]: (r["how"], len(r["lines"])) for r in sections.blocks(df.where("id = 1"), "^# ").collect()}
    assert whole[9] == ("heading", 52) and whole[61] == ("end", 2)


def test_long_documents(spark):
    df = spark.createDataFrame([(1, "\n".join(f"# {i}" if i % 3 == 0 else f"line {i}" for i in range(60_000)))], "id int, text string")
    out = sections.blocks(df, "^# ").agg(F.count("*").alias("n"), F.sum(F.size("lines")).alias("lines")).first()
    assert (out["n"], out["lines"]) == (20_000, 60_000)


def test_rows_labels_and_codes(spark):
    lines = ["v 0", "L a", "v 1", "", "v 2", "L b", "L c", "v 3", " 2020  £1,000 .. £3   £4 ", "2020 £1", "2021 £1 £2 £3 £4"]
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    r = df.select(sections.carried(F.col("lines"), "^L (.)", "^v (.)").alias("c"), sections.median_rows(F.col("lines")).alias("m")).first()
    assert [tuple(x) for x in r["c"]] == [(None, "0"), ("a", "1"), ("a", "2"), ("c", "3")]
    assert [tuple(x) for x in r["m"]] == [(2020, 1000, None, 3, 4), (2021, 1, 2, 3, 4)]
    notices = spark.createDataFrame([("Occupation 3312 in Tables 14, 15 and 20; OCCUPATIONS 12, 345 and 12",), ("none",), ("",)], "n string")
    assert [list(r[0]) for r in notices.select(sections.correction_codes(F.col("n"))).collect()] == [["12", "3312", "345"], [], []]


def test_best_breaks_ties_and_keeps_columns(spark):
    rows = [("g", "/pay-report-2020", 2020, "2019"), ("g", "/x-report", 2020, "2021"), ("g", "/x-report-annex", 2020, "2022"), ("h", None, 2020, None), ("h", "/letter", 2020, "2020"), ("i", "/report", 2020, "1"), ("i", "/REPORT", 2020, "2")]
    df = spark.createDataFrame(rows, "g string, path string, year int, ts string")
    got = {r["g"]: (r["path"], r["score"]) for r in sections.best(df, ["g"], sections.edition_score(F.coalesce("path", F.lit("")), F.col("year"), "pay-report-"), F.col("ts")).collect()}
    assert got == {"g": ("/pay-report-2020", 50), "h": (None, 0), "i": ("/REPORT", 10)}
    assert sections.best(df.where("false"), ["g"], F.lit(1)).count() == 0
    s = df.limit(1).select(sections.attachment_score(F.lit("The 47th annual report"), F.lit("/web"), F.lit(600_000)).alias("a"), sections.attachment_score(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("long")).alias("b")).first()
    assert (s["a"], s["b"]) == (10 + 2 + 1, 0)
