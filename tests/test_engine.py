"""Whole-file parsing, identities of the cube, and operators on small rows."""

import pytest
from pyspark.sql import functions as F

from banderole.functions import dates
from banderole.operators import cube, joins, periods, posts, quality, series
from banderole.plans import stand_in
from banderole.schema import POST, assert_schema
from banderole.sources import posts_csv, shards
from banderole.streaming import events

SF = "/root/testdata/sf0.001"
HEADER = (
    '"Post Unique Reference","Name","Grade (or equivalent)","Job Title","Job/Team Function","Parent Department","Organisation","Unit","Contact Phone",'
    '"Contact E-mail","Reports to Senior Post","Salary Cost of Reports (£)","FTE","Actual Pay Floor (£)","Actual Pay Ceiling (£)","","Professional/Occupational Group","Notes","Valid?"'
)


def row(pur, name, grade, title, floor, ceil, valid="1"):
    return f'"{pur}","{name}","{grade}","{title}","fn","Dept","Dept","Unit","0","e","XX","0","1.00","{floor}","{ceil}","","Policy","","{valid}"'


FILES = {
    "suppressed": [HEADER, row("P1", "Invented Name", "SCS2", "Director, Strategy", 120000, 124999), row("P2", "N/D", "SCS1", "Deputy Director", 0, 0), row("P3", "N/D", "SCS1", "Deputy Director", "N/A", "N/A"), row("P4", "Vacant", "SCS1", "Deputy Director", "", "")],
    "inverted": [HEADER, *(row(f"R{i}", "N/D", "SCS1", "Deputy Director", 70000, 74999, "0") for i in range(8)), *(row("", "", "", "", "", "", "1") for _ in range(40))],
    "normal": [HEADER, *(row(f"R{i}", "N/D", "SCS1", "Deputy Director", 70000, 74999) for i in range(8)), row("BAD", "N/D", "SCS1", "Superseded", 70000, 74999, "0")],
    "repeated": [HEADER, *(row(p, "A B", "SCS1", "Deputy Director", 70000, 74999) for p in ("P1", "P1", "XX"))],
    "junior": ["Parent Department,Organisation,Unit,Reporting Senior Post,Grade,Payscale Minimum (£),Generic Job Title,Number of Posts in FTE", "D,D,U,X,EO,21916,PA,1"],
    "empty": [HEADER],
}


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([(k, bytearray("\r".join(v).encode("cp1252" if k == "normal" else "utf-8"))) for k, v in FILES.items()], "path string, content binary")
    out, verdicts = posts_csv.normalise(posts_csv.raw_rows(files))
    assert_schema(out, POST)
    return {k: sorted((r.asDict() for r in out.collect() if r["file"] == k), key=lambda r: r["row_idx"]) for k in FILES}, {r["file"]: r for r in verdicts.collect()}


def test_suppressed_rows_stay(parsed):
    rows, files = parsed
    got = rows["suppressed"]
    assert [r["withheld_reason"] for r in got] == [None, "zero", "N/A", "blank"]
    assert [r["bin_low"] for r in got] == [24, -1, -1, -1]
    assert got[3]["status"] == "vacant" and got[0]["holder"] == "Invented Name" and got[1]["holder"] is None


def test_valid_flag_only_counts_when_it_can_be_trusted(parsed):
    rows, files = parsed
    assert len(rows["inverted"]) == 8 and not files["inverted"]["valid_applied"] and files["inverted"]["blank_rows"] == 40
    assert len(rows["normal"]) == 8 and files["normal"]["valid_applied"]


def test_repeats_and_refusals(parsed):
    rows, files = parsed
    assert [(r["pur"], r["ordinal"]) for r in rows["repeated"]] == [("P1", 0), ("P1", 1), ("", 0)]
    assert files["junior"]["reason"] == "junior-schema" and files["empty"]["reason"] == "empty"


def test_csv_cells():
    assert posts_csv.cells('a,"b, ""c""\r\nd"\re,f') == [["a", 'b, "c"\nd'], ["e", "f"]]
    assert posts_csv.find_column(["Notes", "Actual Pay Floor (£)"], posts_csv.FIELDS["floor"]) == 1
    assert posts_csv.find_exact(["Grade", "Gradeless"], ("grade",)) == 0


def test_sniff(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"PK\x03\x04"),), (bytearray(b"text"),), (bytearray(b"x"),)], "c binary")
    assert [r[0] for r in df.select(posts_csv.sniff(F.col("c"))).collect()] == ["pdf", "zip/xlsx", None, None]


def test_cube_adds_up_and_round_trips(spark):
    fine = cube.build(stand_in.posts(spark, SF))
    core = cube.build(stand_in.posts(spark, SF), cube.CORE)
    key = lambda df: sorted(str(r.asDict()) for r in df.select(*cube.CORE, *cube.MEASURES).collect())
    assert key(cube.roll_up(fine)) == key(core) == key(cube.decode(cube.encode(core)))


def test_pay_filters_reach_the_scan(spark):
    plan = stand_in.posts(spark, SF).where("org = 'NATION_01'").select("post_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderpriority" not in plan


def test_constant_scope_and_window(spark):
    rows = [("a", "2000"), ("a", "2001"), ("a", "2002"), ("b", "2001"), ("b", "2002"), ("c", "2000")]
    chosen = spark.createDataFrame(rows, "org string, period string")
    assert [r["org"] for r in periods.constant_scope(chosen).collect()] == ["a"]
    best = periods.best_window(chosen).first()
    assert (best["first"], best["last"], best["orgs"], best["score"]) == ("2001", "2002", 2, 4)


def test_quantiles_are_discrete(spark):
    bins = spark.createDataFrame([("g", "p", "lo", 10, 1.0), ("g", "p", "lo", 20, 1.0), ("g", "p", "hi", 11, 2.0)], "group_key string, period string, side string, bin int, w double")
    r = series.quantiles(bins).first()
    assert (r["median_lo"], r["median_hi"], r["p90_lo"]) == (50000.0, 59999.0, 100000.0)


def test_join_only_uses_unique_keys(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",), ("N/A",), ("c",)], "k string")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 4), ("n/a", 5)], "k string, pay int")
    key = (joins.key_of(F.col("k")), joins.key_of(F.col("k")))
    out = joins.two_file_join(left, right, key, ["pay"]).collect()
    assert len(out) == 5 and [(r["k"], r["pay"]) for r in out if r["matched"]] == [("a", 1)]
    assert joins.choose_key([{"candidate": "x", "place": 0, "rate": 0.5}, {"candidate": "y", "place": 1, "rate": 0.58}]) == "x"


def test_shards_and_dictionaries(spark):
    df = spark.createDataFrame([("o", ([1, 2], ["x", "y"]))], "org string, data struct<a:array<int>,b:array<string>>")
    rows = shards.to_rows(df, "data", ["a", "b"], ["org"])
    assert [(r["pos"], r["a"], r["b"]) for r in rows.orderBy("pos").collect()] == [(0, 1, "x"), (1, 2, "y")]
    assert shards.to_columns(rows, ["org"], ["a", "b"], ["pos"]).first()["data"].asDict() == {"a": [1, 2], "b": ["x", "y"]}
    with pytest.raises(Exception, match="unequal"):
        shards.to_rows(spark.createDataFrame([("o", ([1], ["x", "y"]))], df.schema), "data", ["a", "b"], ["org"]).collect()
    assert {r["b"]: r["id"] for r in shards.dictionary(rows, "b").collect()} == {"x": 0, "y": 1}


def test_digest_ignores_order_and_stamp(spark):
    df = spark.range(50).withColumn("stamp", F.rand())
    assert quality.digest(df, "stamp").first() == quality.digest(df.orderBy(F.desc("id")).withColumn("stamp", F.lit(0)), "stamp").first()


def test_growth_of_dates(spark):
    d = spark.createDataFrame([("2019-03-07",)], "d string").select(F.col("d").cast("date").alias("d"))
    assert str(d.select(dates.preceding_quarter_end(F.col("d"))).first()[0]) == "2018-12-31"


def test_trajectory_needs_three_points(spark):
    t = posts.trajectory(stand_in.posts(spark, SF)).select(F.min(F.size("points"))).first()[0]
    assert t is None or t >= 3


def test_streamed_periods_equal_the_tables(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").repartition(4).write.parquet(src)
    out = events.period_counts(events.read_events(spark, src), late="60 days")
    q = out.writeStream.outputMode("complete").format("memory").queryName("periods").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r["period_start"]), r["event_type"], r["events"]) for r in df.collect())
    assert key(spark.table("periods")) == key(events.period_counts(spark.read.parquet(src)))
