"""Published tables: suppressions, floors, first rows, indexes and names."""

from banderole.functions import fmt
from banderole.operators import benchmarks
from pyspark.sql import functions as F


def test_stats_keep_reasons_and_floors(spark):
    # jobs are rounded before they are counted, so 30 of them are none
    rows = [("0.03", "1,234.5", "x"), ("0.029", "100", "200"), ("..", "100.4", ""), ("5", "[c]", "£7"), (None, None, None)]
    df = spark.createDataFrame(rows, "jobs string, median string, p90 string")
    cells = {c: F.col(c) for c in df.columns}
    got = [r["s"] for r in df.select(benchmarks.stats(cells).alias("s")).collect()]
    assert [(r["jobs"], r["median"], r["p90"], r["n_known"]) for r in got] == [(0.0, None, None, True), (0.0, None, None, True), (None, 100.0, None, False), (5.0, None, 7.0, True), (None, None, None, False)]
    assert got[3]["suppressed"] == {"median": "confidential"} and got[2]["suppressed"] == {"jobs": "disclosive", "p90": "blank"}
    weekly = df.select(benchmarks.stats(cells, weekly=True).alias("s")).collect()[2]["s"]
    assert weekly["median"] == 100.4


def test_few_jobs_leave_no_amount(spark):
    df = spark.createDataFrame([("0.1", "5", "6"), ("0", "5", "6"), ("0", "x", "6")], "jobs string, median string, p90 string")
    got = [r["s"] for r in df.select(benchmarks.stats({c: F.col(c) for c in df.columns}).alias("s")).collect()]
    assert [(r["median"], r["p90"]) for r in got] == [(5.0, 6.0), (None, None), (None, 6.0)]
    assert got[1]["suppressed"] == {"n_floor": "below-30"} and got[2]["suppressed"] == {"median": "unreliable"}


def test_first_row_of_a_code_and_regions(spark):
    df = spark.createDataFrame([(" 12 ", 2, 0), ("12", 1, 9), (None, 0, 0), ("", 0, 0), ("3", 5, None)], "code string, k int, region_idx int")
    first = benchmarks.row_by_code(df, "code", "k")
    got = benchmarks.region_rows(first, spark.createDataFrame([(0, "North"), (9, None)], "region_idx int, region string"))
    assert sorted((r["code"], r["k"], r["region"]) for r in got.collect()) == [("12", 1, "—"), ("3", 5, "—")]


def test_index_needs_more_than_five_points(spark):
    of = lambda n, odd=0: spark.createDataFrame([(2000 + i, 100.0 + i) for i in range(n)] + [(1990 + i, x) for i, x in enumerate([0.0, float("nan"), None][:odd])], "year int, index double")
    back = spark.createDataFrame([(1, 1.0)], "year int, index double")
    assert benchmarks.index_or(of(6), back).count() == 6
    assert [tuple(r) for r in benchmarks.index_or(of(5, 3), back).collect()] == [(1, 1.0, False)]
    assert benchmarks.index_or(of(0), back).count() == 1


def test_resources_and_tallies(spark):
    df = spark.createDataFrame([("a.CSV?x", None, "Senior"), ("a.csvx", "csv", None), (None, None, None), ("%zz senior", "", "JUNIOR")], "u string, k string, n string")
    got = [tuple(r) for r in df.select(benchmarks.is_csv(F.col("u"), F.col("k")), benchmarks.looks_senior(F.col("u"), F.col("n"))).collect()]
    assert got == [(True, True), (True, False), (False, False), (False, False)]
    t = benchmarks.tally(spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "y")], "g string, v string"), "g", key="v")
    assert {r["g"]: r["counts"] for r in t.collect()} == {"a": {"x": 2, "": 1}, "b": {"y": 1}}


def test_measures_print_in_their_unit(spark):
    df = spark.createDataFrame([("disclosureRate", 0.5), ("fte", 2.25), ("headcount", 1234.0), ("paybill", 2_500_000.0), ("meanPay", 91_499.0), ("p90", 5.4), ("what", None)], "m string, v double")
    got = [tuple(r) for r in df.select(fmt.measure_text(F.col("m"), F.col("v")), fmt.measure_label(F.col("m")), fmt.measure_unit(F.col("m"))).collect()]
    assert [g[0] for g in got][2:] == ["1,234", "£2.5m", "£91,000", "£5", "—"] and got[0][0] == "50.0%"
    assert got[6][1] == "what" and got[1][2] == "full-time equivalent"
