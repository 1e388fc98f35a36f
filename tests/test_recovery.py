"""Market pages, work lists, redirect chases and occupation codes, case by case."""

from pyspark.sql import functions as F

from banderole.operators import occupations, recovery
from banderole.sources import market_pages


def page(section):
    return f"<html><section id='a'></section>{section}<section id='z'></section></html>"


def test_pages_that_cannot_be_read(spark):
    head = '<section id="headline_statistics">'
    rows = [(1, None), (2, page("")), (3, page(head + "none</section>")), (4, page(head + '<table class="summary"><tr><td>Median annual salary</td><td>£1</td></tr></table></section>')), (5, page(head + '<table class="summary"></table></section>'))]
    got = {r["page_id"]: (r["error"], r["title"]) for r in market_pages.title_pages(spark.createDataFrame(rows, "page_id int, html string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "no headline_statistics section", 2: "no headline_statistics section", 3: "no summary table", 4: "summary table has no salary-count row", 5: "summary table has no salary-count row"}
    assert all(v[1] is None for v in got.values())


def test_first_row_of_a_label_counts(spark):
    table = '<table class="summary"><tr><td>Number of salaries quoted</td><td>0</td></tr><tr><td>Number of salaries quoted</td><td>9</td></tr><tr><td>Median annual salary</td><td>0</td></tr></table>'
    df = spark.createDataFrame([(1, page(f'<section id="headline_statistics">{table}</section>'))], "page_id int, html string")
    title = market_pages.title_pages(df).first()["title"]
    assert (title["n"], title["median"], title["periods"], title["prior"][0]["n"]) == (0, None, [], None)


def test_periods(spark):
    cases = ["6 months to 15 Aug 2026", "3 Months to 1 September 2020", "Same period 2025", "to 5 Foo 2020", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = [r["p"] and (r["p"]["months"], r["p"]["window_end"]) for r in df.select("i", market_pages.period(F.col("c")).alias("p")).orderBy("i").collect()]
    assert got == [(6, "2026-08-15"), (3, "2020-09-01"), (None, None), (None, None), None]


def test_places_keep_the_last(spark):
    html = '<table class="tab tabLocations"><tr><td>Location</td></tr><tr><td>Leeds</td><td></td><td>1</td><td>£5</td></tr><tr><td> leeds </td><td></td><td>x</td><td>0</td></tr></table>'
    got = market_pages.places(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")).collect()
    assert [tuple(r) for r in got] == [(1, "leeds", None, None)]


def test_work_list(spark):
    item, said = "url string, org string, date string, reason string", "url string, org string, date string"
    failures = spark.createDataFrame([("a", "F", None, "404"), ("a", "F", None, "404")], item)
    tried = spark.createDataFrame([("a", "T", "2012-01-01", None, None), ("b", "T", "2012-01-01", None, None), ("c", "T", None, None, "pay-side")], item + ", kind string")
    asked = spark.createDataFrame([("b", "ADHOC", None, "ad-hoc"), ("d", "ADHOC", "2015-01-01", "ad-hoc")], item)
    resources, siblings = spark.createDataFrame([("b", "R", "2013-01-01"), ("a", "R", "2013-01-01")], said), spark.createDataFrame([("b", "S", None)], said)
    items = recovery.work_list(failures, tried, asked, resources, siblings)
    assert sorted(map(tuple, items.collect())) == [("a", "F", None, "404"), ("b", "S", "2012-01-01", "previously-attempted"), ("d", "ADHOC", "2015-01-01", "ad-hoc")]
    assert sorted(r["url"] for r in recovery.within(items, None, None, "2014-01-01").collect()) == ["a", "b"]
    assert [r["url"] for r in recovery.within(items, ["s"]).collect()] == ["b"]


def test_chases(spark):
    captures = spark.createDataFrame([("http://end", "2012"), ("http://five", "2012")], "url string, timestamp string")
    redirects = [("http://a", "http://end"), ("http://loop", "http://pool"), ("http://pool", "http://loop"), ("http://odd", "mailto:x"), ("http://pages", None), ("http://gone", "http://never")]
    redirects += [(f"http://{a}", f"http://{b}") for a, b in zip(["one", "two", "three", "four"], ["two", "three", "four", "five"])]
    asked = ["http://end", "http://a", "http://loop", "http://odd", "http://pages", "http://gone", "http://one", "http://two", "http://nowhere"]
    urls, moves = spark.createDataFrame([(u,) for u in asked], "url string"), spark.createDataFrame(redirects, "url string, target string")
    got = {r["url"][7:]: (r["origin"], r["hops"], r["reason"]) for r in recovery.resolve(urls, captures, moves).collect()}
    lost = "only-redirects"
    assert got == {
        "end": ("http://end", 0, None), "a": ("http://end", 1, None), "loop": (None, 1, lost), "odd": (None, 0, lost), "pages": (None, 0, lost),
        "gone": (None, 1, lost), "one": (None, 3, lost), "two": ("http://five", 3, None), "nowhere": (None, 0, "no-capture"),
    }


def test_occupations(spark):
    rows = spark.createDataFrame([("Law", "G1"), ("Art", "G1"), ("Art", None), (None, None)], "prof string, grade string")
    listed = lambda *x: spark.createDataFrame(x, "name string, code string, role string, confidence string")
    laws = listed(("Law", "2412", "Legal", "hypothesis"))
    got = occupations.joined_by(rows, laws, listed(("G1", "1111", "Head", "fact")))
    assert sorted((str(r["prof"]), str(r["grade"]), r["code"]) for r in got.collect()) == [("Art", "G1", "1111"), ("Art", "None", None), ("Law", "G1", "2412"), ("None", "None", None)]
    assert [r["prof"] for r in occupations.without_comparator(rows, laws).collect()] == ["Art"]
