"""Planted faults are found wherever they lie; clean tables pass."""

import datetime

from banderole.operators import honesty
from pyspark.sql import functions as F

KIND = "id string, t struct<src:string,median:double,rows:array<struct<min:int,note:string,cells:array<array<struct<sourceUrl:string,marketComparison:string,mean:double>>>,by:map<string,struct<median:double,p90:double>>>>>"


def test_faults_at_any_depth_with_their_paths(spark):
    cell = lambda url, cmp, mean: (url, cmp, mean)
    rows = [
        ("clean", ("s", 1.0, [(1, "n", [[cell(None, "x", 2.0)]], {"a": (3.0, None)})])),
        ("bare", (None, 5.0, [(0, "n", [[], [cell("u", "x", 0.0), cell(None, "x", 1.0)]], {"a": (None, 0.0), "b": (2.0, 1.0)})])),
        ("nulls", (None, None, [None, (None, None, None, None), (None, None, [None, [None]], {"a": None})])),
        ("none", None),
        ("nan", ("s", float("nan"), [])),
    ]
    got = sorted((r["id"], r["path"], r["problem"]) for r in honesty.figures(spark.createDataFrame(rows, KIND), ["t"], "id").collect())
    assert got == sorted([
        ("bare", "t", honesty.UNSOURCED), ("bare", "t.rows[0].min", honesty.ZERO), ("bare", "t.rows[0].cells[1][0].mean", honesty.ZERO),
        ("bare", "t.rows[0].cells[1][1]", honesty.UNSOURCED), ("bare", "t.rows[0].by.a.p90", honesty.ZERO), ("bare", "t.rows[0].by.b", honesty.UNSOURCED),
    ])


def test_tables_without_nested_columns(spark):
    df = spark.createDataFrame([(1, 0.0)], "id int, median double")
    assert [tuple(r) for r in honesty.figures(df.select("id", F.struct("median").alias("t")), ["t"], "id").collect()] == [(1, "t.median", honesty.ZERO), (1, "t", honesty.UNSOURCED)]
    assert honesty.figures(df.where("false").select("id", F.struct("median").alias("t")), ["t"], "id").count() == 0


def test_curated_rules(spark):
    day = datetime.date
    rows = [
        ("fine", day(2026, 1, 1), True, None, "u", "fact", True), ("never", None, None, None, None, None, True), ("old", day(2024, 1, 1), True, None, "u", "fact", True),
        ("open", day(2026, 1, 1), False, None, None, "guess", True), ("marked", day(2026, 1, 1), False, False, None, "contested", True), ("empty", day(2026, 1, 1), None, None, None, None, False),
    ]
    df = spark.createDataFrame(rows, "id string, lastReviewed date, verified boolean, resolved boolean, sourceUrl string, confidence string, has_values boolean")
    got = {}
    for r in honesty.curated(df, F.lit("2026-06-30").cast("date")).collect():
        got.setdefault(r["id"], set()).add(r["problem"])
    assert got == {
        "never": {"never reviewed"}, "old": {"reviewed too long ago"}, "empty": {"no verified flag", "confidence of no known kind"},
        "open": {"unverified values that aren't marked", "values without a source that aren't marked", "confidence of no known kind"},
    }
