"""Figures from laid-out page text: whole charts, awkward ones, refusals."""

from banderole.operators import figures
from pyspark.sql import functions as F

LEGEND = "      Deputy director Private     Deputy director Public     Director Private     Director Public"
AXIS = " " * 20 + "2022" + " " * 16 + "2023" + " " * 26 + "2022" + " " * 16 + "2023"
TICKS = [f"{-10 * k}%".rjust(8) for k in range(7)]


def chart(labels, legend=LEGEND, axis=AXIS, ticks=TICKS, caption="Figure 3.7: Difference in median pay, private and public"):
    """labels: (end, text), each on a line beside a tick."""
    lines = [(ticks[k] if k < len(ticks) else "").ljust(8) + text.rjust(end - 8) for k, (end, text) in enumerate(labels)]
    return "\n".join([caption, legend, *lines, *ticks[len(labels) :], axis])


WHOLE = [(20, "-11%"), (28, "-12%"), (40, "-21%"), (48, "-22 %"), (70, "-31%"), (78, "-32%"), (90, "-41%"), (98, "-42%")]
POINTS = [(b, y, -p) for b, y, p in (("Deputy director Private", 2022, 11), ("Deputy director Public", 2022, 12), ("Deputy director Private", 2023, 21), ("Deputy director Public", 2023, 22), ("Director Private", 2022, 31), ("Director Public", 2022, 32), ("Director Private", 2023, 41), ("Director Public", 2023, 42))]
BAND = "Figure 4.1: Salary comparison: median pay in the private sector in 2024\n\n" + "\n".join(TICKS[:5]) + "\n" + " " * 19 + "-7%" + " " * 27 + "-9%" + " " * 60 + "-1%\n" + " " * 18 + "Deputy director 1A" + " " * 14 + "Director"


def readings(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page int, text string")
    return {r["page"]: r for r in figures.read(df).collect()}


def test_whole_chart_and_a_label_of_no_series(spark):
    got = readings(spark, chart(WHOLE), chart([*WHOLE[:2], (26, "-99%"), *WHOLE[2:]]), chart(WHOLE[:2] + WHOLE[3:]))
    assert sorted(map(tuple, got[0]["points"])) == sorted(POINTS) and got[0]["loose"] == []
    # three labels for two series: the ones nearest to the year stay, the other is shown
    assert [tuple(x) for x in got[1]["loose"]] == [(2022, -12, 28)]
    assert (("Deputy director Public", 2022, -99)) in [tuple(p) for p in got[1]["points"]]
    # a label is missing: its year isn't guessed
    assert [tuple(x) for x in got[2]["loose"]] == [(2023, -22, 48)]
    assert sorted(map(tuple, got[2]["points"])) == sorted(p for p in POINTS if not (p[1] == 2023 and p[0].startswith("Deputy")))


def test_bands_along_the_axis(spark):
    r = readings(spark, BAND)[0]
    assert r["shape"] == "band-axis" and sorted(map(tuple, r["points"])) == [("Deputy director 1A Private", 2024, -7), ("Director Private", 2024, -9)]
    assert [tuple(x) for x in r["loose"]] == [(2024, -1, 115)]


def test_refusals_have_reasons(spark):
    two = BAND.replace("in the private sector", "in private and public sectors")
    got = readings(spark, None, "", "no figure, 5%", chart(WHOLE, legend=""), chart(WHOLE, axis="2022"), chart([]), two, "Figure 1.1: difference in pay, private")
    assert set(got) == {3, 4, 5, 6, 7}
    assert got[3]["refused"] == "no legend; no year in the caption"
    assert got[4]["refused"] == "no year axis; no year in the caption"
    assert got[5]["refused"] == "no labels beside the axis; no year in the caption"
    assert got[6]["refused"] == "no legend; not one sector"
    assert got[7]["refused"] == "no legend; no year in the caption" and got[7]["points"] is None


def test_axis_ticks_of_unequal_width_are_one_column(spark):
    ticks = ["      0%", *TICKS[1:]]
    r = readings(spark, chart(WHOLE, ticks=ticks))[0]
    assert len(r["points"]) == 8 and r["loose"] == []


def test_captions_wrap_and_notes_run_on(spark):
    text = chart(WHOLE).replace("public\n", "public\nover two years\n") + "\nSource:  Cabinet\tOffice \nNote: one\n two\n\n three\nfour\nfive"
    r = readings(spark, text)[0]
    assert r["caption"] == "Difference in median pay, private and public over two years"
    assert (r["source"], r["note"]) == ("Source: Cabinet Office", "Note: one two three four")


def test_spots(spark):
    df = spark.createDataFrame([("10%20% -5 %x",), ("",), (None,), ("a\u0001 7%",)], "l string")
    got = [r[0] and [tuple(s) for s in r[0]] for r in df.select(figures.spots(F.col("l"), figures.PERCENT)).collect()]
    assert got == [[("10%", 0, 3), ("20%", 3, 6), ("-5 %", 7, 11)], [], None, [("7%", 3, 5)]]


def test_anchors(spark):
    read = spark.createDataFrame([(1, "Director Private", 2022, -5)], "edition int, series string, year int, pct int")
    anchors = spark.createDataFrame([(1, "Director Private", 2022, -5), (1, "Director Public", 2022, -6)], read.schema)
    assert [tuple(r) for r in figures.broken_anchors(read, anchors).collect()] == [(1, "Director Public", 2022, -6, None)]
