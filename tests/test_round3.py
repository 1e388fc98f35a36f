"""Queries against their SQL on rows that the given tables don't hold."""

import os
import shutil

import duckdb
import pytest

from banderole.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives its SQL's rows on the smallest tables with more rows in one."""

    def of(name: str, table: str, more: str) -> bool:
        for f in os.listdir(SF):
            shutil.copyfile(f"{SF}/{f}", tmp_path / f)
        duck = duckdb.connect()
        duck.sql(f"copy (select * from '{SF}/{table}.parquet' union all {more}) to '{tmp_path}/{table}.parquet' (format parquet)")
        for f in os.listdir(SF):
            duck.sql(f"create view {f[:-8]} as select * from '{tmp_path}/{f}'")
        df = QUERIES[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        want = duck.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
        return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(want, key=str)

    return of


def test_sign_of_a_change_that_rounds_to_nothing(same):
    assert same("format_figures", "customer", "select 900000 + i, 'odd', 1, (i - 100) / 100.0, 'X' from range(200) r(i)")


def test_titles_keep_entities_that_are_not_markup(same):
    odd = ["<h1>a &quot;b&quot; &amp;lt; &#39;c&nbsp; d</h1>", "<h1>a\r\v  b</h1>", "<h1>a\nb</h1>", "", "<h1>  &pound;1 <b>x</b></h1>"]
    rows = ", ".join("('" + h.replace("'", "''") + "')" for h in odd)
    assert same("html_titles", "pages", f"select 900000 + row_number() over (), 'u', h from (values {rows}) v(h)")


def test_a_page_is_read_once_and_in_all_partitions(spark):
    """Points and loose values are filtered by what is read; the plan holds each reading one time, and none below the shuffle."""
    for name in ("gap_figure_points", "gap_figure_loose"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("no legend") == 1 and plan.count("no bands") == 1
        assert "Figure" not in plan.split("RepartitionByExpression", 1)[1]


def test_no_round_of_a_tree_is_broadcast(spark):
    from banderole.operators import tree

    rows = spark.createDataFrame([("o", "d", str(k), str(k // 2)) for k in range(1, 40)], "org string, date string, pur string, parent string")
    up = tree._jump(rows.withColumn("up", rows["parent"]), {"up": rows["parent"]})
    plan = up._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_choices_of_all_rounds_are_appended_to_one_table(spark):
    from banderole import store
    from banderole.operators import probe

    posts = spark.createDataFrame([(f"u{k}", "o", "d", k) for k in range(4)], "url string, org string, date string, place int")
    rates = spark.createDataFrame([(f"u{k}", f"p{j}", 0.9 - j / 10) for k in range(4) for j in range(2)], "url string, pay string, rate double")
    before = len(store._made)
    got = {r["url"]: (r["pay"], r["status"]) for r in probe.halves(posts, rates).collect()}
    assert got == {"u0": ("p0", "joined"), "u1": ("p1", "joined"), "u2": (None, "no-pay-file-found"), "u3": (None, "no-pay-file-found")}
    assert sum("halves-done" in p for p in store._made[before:]) == 1


def test_a_file_passes_in_batches_of_rows():
    from banderole.sources import high_earners, posts_csv

    taken = []

    def text_lines():
        for k in range(12_001):
            taken.append(k)
            yield [str(k), k, True]

    sizes = [(b.num_rows, len(taken)) for b in posts_csv.batched(text_lines(), "a string, b int, c boolean")]
    assert sizes == [(5000, 5000), (10000 - 5000, 10_000), (2001, 12_001)]
    head, rows = posts_csv.opened('a,"b\rc"\rd,e\r\n"x""y\n",z'.encode())
    assert head == ["a", "b\nc"] and next(rows) == ["d", "e"] and list(rows) == [['x"y\n', "z"]]
    assert posts_csv.opened(b"only,head")[1] is None and posts_csv.opened(b"") == ([], None)
    assert high_earners.opened is posts_csv.opened
