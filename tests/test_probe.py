"""The probe's stages, its halves and the state between runs."""

from banderole.operators import probe
from pyspark.sql import functions as F

ITEMS = "url string, org string, date string, reason string"


def tables(spark, resolved=(), bodies=(), parsed=()):
    return (
        spark.createDataFrame(list(resolved), "url string, origin string, timestamp string, reason string"), spark.createDataFrame(list(bodies), "url string, ok boolean, reason string, detail string, sha256 string"),
        spark.createDataFrame(list(parsed), "url string, ok boolean, reason string, rows int, columns int"),
    )


def test_first_stage_that_ends_a_file_names_it(spark):
    items = spark.createDataFrame([(u, "o", "d", "junior" if u == "a" else None) for u in "abcdefg"] + [("g", None, None, None), ("g", "o", "d", None)], ITEMS)
    got = probe.verdicts(
        items, *tables(
            spark, [("a", None, None, "no-capture"), ("b", None, None, "only-redirects"), *((u, u, "2019", None) for u in "cdef")], [("c", False, "archived-body-is-html", None, None), *((u, True, None, None, u) for u in "def")],
            [("d", True, None, 1, 51), ("e", True, None, 1, 50), ("f", False, "no-pay-columns", 2, 60)],
        ), out_of_scope={"junior": "another unit"},
    )
    assert {r["url"]: (r["status"], r["detail"]) for r in got.collect()} == {
        "a": ("out-of-scope", "another unit"), "b": ("only-redirects", None), "c": ("archived-body-is-html", None), "d": ("lone-cr-not-normalised", "1 row x 51 columns"),
        "e": ("ok", None), "f": ("no-pay-columns", None), "g": (None, None),
    }
    assert got.where("url = 'g'").count() == 1
    assert probe.verdicts(items.where("false"), *tables(spark)).count() == 0


def test_halves_are_taken_once_in_order(spark):
    posts = spark.createDataFrame([("p1", "o", "d", 1), ("p2", "o", "d", 2), ("p3", "o", "d", 3), ("p4", "o", "d", 4), ("q1", "x", "d", 1)], "url string, org string, date string, place int")
    rates = spark.createDataFrame([("p1", "b", 0.9), ("p1", "a", 0.9), ("p2", "a", 1.0), ("p2", "b", 0.5), ("p3", "a", 0.8), ("p3", "c", 0.49), ("p4", "c", 0.6)], "url string, pay string, rate double")
    got = {r["url"]: (r["pay"], r["status"]) for r in probe.halves(posts, rates).collect()}
    assert got == {"p1": ("a", "joined"), "p2": ("b", "joined"), "p3": ("c", "pay-join-too-sparse"), "p4": ("c", "joined"), "q1": (None, "no-pay-file-found")}
    assert probe.halves(posts.where("false"), rates).count() == 0


def test_second_run_redoes_nothing_and_changes_are_seen(spark):
    items = spark.createDataFrame([("a", "1", None), ("b", None, ""), ("c", "", None)], "url string, x string, y string")
    none = spark.createDataFrame([], probe.STATE)
    todo = probe.pending(items, none, ["x", "y"])
    assert todo.count() == 3
    state = probe.merged(none, todo.withColumns({"status": F.when(F.col("url") != "c", "ok"), "detail": F.lit(None).cast("string")}), 1)
    assert [r["url"] for r in probe.pending(items, state, ["x", "y"]).collect()] == ["c"]
    changed = items.withColumn("y", F.when(F.col("url") == "b", None).otherwise(F.col("y")))
    again = probe.pending(changed, state, ["x", "y"])
    assert sorted(r["url"] for r in again.collect()) == ["b", "c"]
    after = probe.merged(state, again.withColumns({"status": F.lit("empty"), "detail": F.lit("d")}), 2)
    assert {r["url"]: (r["status"], r["run"]) for r in after.collect()} == {"a": ("ok", 1), "b": ("empty", 2), "c": ("empty", 2)}
    assert probe.pending(changed, after, ["x", "y"]).count() == 0


def test_reports(spark):
    state = spark.createDataFrame([("v", "f", "ok", None, 1), ("p", "f", "no-pay-columns", None, 1), ("q", "f", "no-pay-columns", None, 1), ("y", "f", "no-post-columns", None, 2), ("n", "f", "no-capture", "x", 2)], probe.STATE)
    joined = spark.createDataFrame([("p", "y", 0.9, "joined"), ("q", None, None, "no-pay-file-found")], "url string, pay string, rate double, status string")
    found, lost = probe.reports(state, joined)
    assert {r["url"]: (r["kind"], r["pay"]) for r in found.collect()} == {"v": ("verbatim", None), "p": ("joined", "y"), "y": ("pay-side", None)}
    assert {r["url"]: (r["reason"], r["files"]) for r in lost.collect()} == {"q": ("no-pay-file-found", 1), "n": ("no-capture", 1)}
