"""Registered queries against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from banderole.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
FAST = [
    "band_classify", "cube_core", "cube_rollup_check", "period_index", "chosen_filing", "coverage_matrix", "pay_median_band", "series_mean_pay", "constant_scope_window", "lineage_exclusions",
    "post_groups", "post_succession", "gaps_islands", "dedupe_siblings", "two_file_join", "join_key_choice", "org_tree_depth", "org_span", "org_subtree", "high_earner_series", "diff_gates",
    "joint_medians", "population_survey", "normalise_grade", "normalise_profession", "post_status", "parse_money_fte", "reference_date", "suppression_decode", "figure_gate", "format_bands",
    "bm25_search", "token_stats", "html_items", "json_props", "events_window",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    v = lambda x: None if x is None or x != x else repr(round(x, 6)) if isinstance(x, float) else str(x)
    return sorted((tuple(map(v, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", FAST)
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert plain(tuple(r[c] for c in cols) for r in df.collect()) == plain(want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
