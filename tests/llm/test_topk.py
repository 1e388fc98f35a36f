"""Exact top-k against brute force over all pairs."""

import math

import numpy as np
import pytest

from banderole.llm import topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k, asked, scale=64):
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ints:
        if i % asked == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ints if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16) / 4], "x") for i in range(900)]
    rows += [(1000 + i, rows[3][1], "copy") for i in range(200)]  # ties by id
    rows += [(2000, None, ""), (2020, [], ""), (2040, [1.0, None], ""), (2060, [float("nan")], ""), (2080, [float("inf")] * 16, ""), (2100, [0.5] * 5, ""), (2120, [-2.0] * 20, ""), (None, [9.0] * 16, "")]
    return rows


@pytest.mark.parametrize("block,group,cells", [(256, 8192, None), (8, 10, 7), (1, 3, 1), (64, 16, 40)])
def test_equals_brute_force(spark, vectors, block, group, cells):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(5)
    got = rows_of(topk.search(df, F.col("vec_id") % 20 == 0, k=20, block=block, group=group, cells=cells))
    assert got == brute(vectors, 20, 20)


def test_repeated_ids_few_rows_and_empty_tables(spark):
    rows = [(0, [1.0], ""), (0, [1.0], ""), (1, [2.0], ""), (2, [1.0], ""), (2, [1.0], "")]
    got = rows_of(topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert got == sorted(2 * [(0, 1, 1, 8192), (0, 2, 2, 4096), (0, 3, 2, 4096)])
    one = spark.createDataFrame([(0, [1.0], "")], SCHEMA)
    assert topk.search(one, F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(one.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(one, F.lit(None).cast("boolean")).count() == 0


def test_weights_beyond_doubles_are_exact(spark):
    rows = [(0, [2.0**40, 1.0], ""), (1, [2.0**40, 0.5], ""), (2, [2.0**40, 1.5], ""), (3, [1e300, 1.0], ""), (4, [-1e300, 1.0], ""), (5, [-3e300, 1.0], ""), (6, [2e300, 0.0], ""), (7, [1.0, 1.0], "")]
    got = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, block=2).collect()
    want = brute(rows, 20, 20)
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(r, j) for _, r, j, _ in want]
    assert all(g["score"] == max(-(2**63), min(2**63 - 1, w[3])) for g, w in zip(sorted(got, key=lambda r: r["rank"]), want))


def test_blocks_below_the_kth_score_are_not_scored():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(32, 16)) * 40
    mats = [np.floor(c + rng.normal(size=(64, 16))) for c in centres]
    blocks = [(np.arange(64) + 64 * b, m) for b, m in enumerate(mats)]
    q = np.floor(centres[5:6] + 1)
    best = topk.Best(1, 10, np.float64)
    scored = topk.search_buffer(q, np.array([-1]), blocks, best)
    every = np.concatenate(mats) @ q[0]
    assert scored < 8
    assert best.scores[0].tolist() == sorted(every, reverse=True)[:10]
