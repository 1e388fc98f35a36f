"""Rules on cells, names, grades, titles and archive answers, case by case."""

import pytest
from pyspark.sql import functions as F

from banderole.functions import classify, dates, fmt
from banderole.operators import corpus, highearners, joins, retrieval
from banderole.sources import high_earners, posts_csv


def values(spark, cases, of):
    """What a column function makes of each case, in order."""
    rows = [(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)]
    width = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{k} string" for k in range(width)))
    return [r["v"] for r in df.select("i", of(*(F.col(f"c{k}") for k in range(width))).alias("v")).orderBy("i").collect()]


def test_names(spark):
    cases = [("Elm", "Jo", None), (None, None, " Jo   Elm "), ("", "", "N/D"), ("Vacant", "", ""), ("", "", "—"), ("", "Jo", ""), ("", "", "x" * 90), (None, None, None)]
    assert values(spark, cases, high_earners.name) == ["Jo Elm", "Jo Elm", None, None, None, "Jo", "x" * 80, None]


def test_grades_of_lists(spark):
    cases = ["Non-Executive Director", "Chair", "VSM", "Lieutenant General", "General", "Director General", "SCS1A", ""]
    got = values(spark, cases, high_earners.grade)
    assert [(g["band"], g["variant"]) for g in got] == [
        ("Non-executive / chair", None), ("Non-executive / chair", None), ("NHS very senior manager", None), ("Military (OF-6+)", "OF-8"),
        ("Military (OF-6+)", "OF-9"), ("SCS3 (Dir Gen)", None), ("SCS1 (Dep Dir)", "SCS1A"), ("Other / Not stated", None),
    ]


def test_pay_of_lists(spark):
    cases = [("150000", "154999"), ("154999", "150000"), ("150000", None), (None, "150000"), ("40k", "40k"), ("0", ""), (None, None)]
    got = values(spark, cases, lambda a, b: high_earners.pay(classify.amount(a), classify.amount(b)))
    assert [tuple(g) for g in got] == [("band", 150000, 154999), ("band", 150000, 154999), ("floor-only", 150000, None), ("exact", 150000, 150000), ("exact", 40000, 40000), ("not-published", None, None), ("not-published", None, None)]


def test_editions(spark):
    got = values(spark, ["List as at 30 September 2015", "List as at 5 Mai 2015", "High earners 2011", "none", None], high_earners.edition)
    assert [g and tuple(g) for g in got] == [("2015-09-30", 2015, "2015-09-30", "declared"), ("2015", 2015, None, "year-only"), ("2011", 2011, None, "year-only"), None, None]


@pytest.mark.parametrize(
    "header, shape",
    [("Name,Organisation,Annual pay rate (£)", "A"), ("Organisation,Total Pay Floor (£),Total Pay Ceiling (£)", "B"), ("Organisation,Total pay floor and ceiling range (£)", "C"), ("Organisation,Pay", None)],
)
def test_shapes(header, shape):
    assert high_earners.shape_of(header.split(",")) == shape


def test_refused_lists(spark):
    files = [("a", b""), ("b", b"Organisation,Pay\nX,1\n"), ("c", b"Annual pay rate\n1\n"), ("d", "Organisation,Annual pay rate\nX,£40k\n,\n".encode())]
    raw = high_earners.raw_rows(spark.createDataFrame(files, "path string, content binary"))
    got = {r["file"]: (r["reason"], r["data_rows"], r["blank_rows"]) for r in high_earners.file_stats(raw).collect()}
    assert got == {"a": ("empty", 0, 0), "b": ("no-pay-columns", 0, 0), "c": ("no-post-columns", 0, 0), "d": (None, 2, 1)}


def test_archive_answers(spark):
    table = '[["timestamp","statuscode"],["20120101000000","200"],["2013","302"]]'
    lines = '{"timestamp": "20120101000000", "status": "200"}\n\n{"timestamp": "2013", "status": "302"}'
    got = values(spark, [table, lines, "[]"], corpus.capture_rows)
    assert [[r["timestamp"] for r in g] for g in got[:2]] == [["20120101000000", "2013"]] * 2


def test_captures(spark):
    rows = [(1, "20120101", "200", "text/csv"), (1, "20100101", "200", "text/html"), (1, "20150101", "200", None), (1, "20130101", "302", ""), (2, "x", "200", ""), (1, "20180101", "200", "text/csv")]
    df = spark.createDataFrame(rows, "file int, timestamp string, status string, mime string")
    assert [r["timestamp"] for r in corpus.pick_capture(df, "file").collect()] == ["20120101"]
    assert [r["timestamp"] for r in corpus.pick_capture(df, "file", F.lit("20160601")).collect()] == ["20150101"]
    assert [r["timestamp"] for r in corpus.pick_redirect(df, "file").collect()] == ["20130101"]


def test_cells(spark):
    assert values(spark, ["£1,250", "1250.6", "0", "12 a", None], corpus.strict_money) == [1250, 1251, None, None, None]
    assert values(spark, ["1,250", "1.5", ""], corpus.strict_count) == [1250, None, None]
    assert values(spark, ["A", "Z", "AA", "BC"], corpus.column_index) == [1, 26, 27, 55]
    assert [tuple(x) for x in values(spark, ["x|A", "x|y|B", "|A", "x"], corpus.split_key)] == [("x", "A"), ("x|y", "B"), ("|A", None), ("x", None)]


def test_formats(spark):
    assert values(spark, [("0.1", "0.2"), ("0.1", "0.1")], lambda a, b: fmt.pct_band(a.cast("double"), b.cast("double")))[0].count("%") >= 1
    assert values(spark, ["2016-03-31"], lambda d: dates.date_label(d.cast("date"))) == ["31 March 2016"]
    assert values(spark, [("2016-01-01", "2016-12-31")], lambda a, b: F.round(dates.months_since(a.cast("date"), b.cast("date")), 1)) == [12.0]


def test_table_rows(spark):
    html = "<table><tr><th>A</th><td> x &amp; y </td></tr><tr><td>1</td></tr></table>"
    assert values(spark, [html], retrieval.table_rows) == [[["A", "x & y"], ["1"]]]


def test_types_of_lists(spark):
    rows = spark.createDataFrame([("e", "Civil Service"), ("e", ""), ("e", "Civil Service")], "edition string, org_type string")
    assert highearners.by_type(rows).first()["by_type"] == {"(not published)": 1, "Civil Service": 2}


def test_resource_winner(spark):
    rows = [("p", "d", "2012", "u1", True), ("p", "d", "2013", "u2", True), ("p", "d", "2014", "u3", False)]
    assert joins.resource_winner(spark.createDataFrame(rows, "pkg string, date string, created string, url string, parsed boolean")).first()["url"] == "u2"


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "x"'), ("line\nend", "")]
    posts_csv.write_csv(spark.createDataFrame(rows, "c string, d string").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert posts_csv.cells(posts_csv.decode(part.read_bytes()))[1:] == [list(r) for r in rows]


def test_rate_extremes(spark):
    columns = "group_key string, period string, headcount long, rate double"
    rows = [("a", "2001", 40, 0.5), ("b", "2001", 30, 0.2), ("c", "2001", 29, 0.1), ("d", "2001", 50, None), ("e", "2001", 90, 0.5), ("f", "2000", 99, 0.9), ("a", "2002", 0, None)]
    out = corpus.rate_extremes(spark.createDataFrame(rows, columns), "rate").collect()
    assert [tuple(r) for r in out] == [(3, "b", 0.2, "e", 0.5)]  # 2002 has nobody, c is below thirty, d has no rate
    few = corpus.rate_extremes(spark.createDataFrame(rows[:1], columns), "rate").collect()
    assert [tuple(r) for r in few] == [(1, None, None, None, None)]
    assert [tuple(r) for r in corpus.rate_extremes(spark.createDataFrame([], columns), "rate").collect()] == [(0, None, None, None, None)]
