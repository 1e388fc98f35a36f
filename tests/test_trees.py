"""Trees and closures of any depth against plain walks, cycles and faults of filings included."""

import random
import time

import pytest

from banderole.operators import lineage, tree
from pyspark.sql import functions as F

ROWS = "org string, date string, pur string, reports_to string, status string, floor long, disclosed boolean, grade string, title string, row_idx long"


def frame(spark, rows):
    """rows of (pur, reports_to, status, floor) in one filing, or with an org in front."""
    full = [(r if len(r) == 5 else ("o", *r)) for r in rows]
    return spark.createDataFrame([(o, "2000-01-31", p, up, s, pay, i % 3 != 2, f"g{i % 4}", f"t{i % 7}", i) for i, (o, p, up, s, pay) in enumerate(full)], ROWS)


def walked(rows):
    """Depths by walking up, with the rule for cycles as it is documented."""
    known = {p for p, *_ in rows if p}
    live = [r for r in rows if r[2] != "eliminated" and r[0]]
    parent, first = {}, {}
    for i, (p, up, *_) in enumerate(rows):
        if rows[i] in live:
            first.setdefault(p, i)
            if up and up != p and up in known:
                parent[p] = up
    out = {}
    for p in first:
        path, at = [p], p
        while at in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if at not in parent:
            out[p] = len(path)
        else:
            ring = path[path.index(parent[at]) :]
            out[p] = next(k for k in range(10_000) if hop(parent, p, k) == min(ring, key=lambda m: first[m])) + len(ring) + 1
    return out


def hop(parent, p, k):
    for _ in range(k):
        p = parent[p]
    return p


def test_cycle_repeat_eliminated_parent_and_strays(spark):
    f = "filled-named"
    rows = [("1", "", f, 5), ("2", "1", f, 4), ("2", "1", f, 3), ("3", "2", "eliminated", 1), ("4", "3", f, 2), ("5", "5", f, 1), ("6", "7", f, 1), ("7", "6", f, 1), ("8", "zzz", f, 1), ("9", "7", f, 1), ("", "", f, 1), (None, "1", f, 1)]
    df = frame(spark, rows)
    nodes = tree.resolved(df)
    depth = {r["pur"]: r["depth"] for r in tree.depths(nodes).collect()}
    # the eliminated post is nobody's child any more, but its child keeps it above
    assert depth == {"1": 1, "2": 2, "4": 2, "5": 1, "6": 3, "7": 4, "8": 1, "9": 5}
    assert {(r["pur"], r["cycle"], r["members"]) for r in tree.cycles(nodes).collect()} == {("6", "6", 2), ("7", "6", 2)}
    assert {r["depth"]: r["posts"] for r in tree.layers(nodes).collect()} == {1: 3, 2: 3, 3: 1, 4: 1, 5: 1}
    stats = tree.verdicts(tree.spans(nodes)).first()
    assert (stats["posts"], stats["dangling"], stats["roots"], stats["reporting"], stats["reason"]) == (11, 3, 2, 6, "fewer than 30 posts")
    got = {r["pur"]: (r["parent"], r["depth"], r["size"], r["height"], r["subtree_floor"]) for r in tree.trees(tree.tree_nodes(df)).collect()}
    assert got == {"1": (None, 1, 2, 2, 9), "2": ("1", 2, 1, 1, 4), "4": (None, 1, 1, 1, 2), "5": (None, 1, 1, 1, 0), "8": (None, 1, 1, 1, 0)}
    assert tuple(tree.tree_totals(df).first())[2:] == (5, 4, 4, 3)


def test_eight_rows_with_a_two_post_cycle(spark):
    rows = [("1", "", "x", 1), *((str(i), str(i - 1), "x", 1) for i in range(2, 7)), ("7", "8", "x", 1), ("8", "7", "x", 1)]
    df = frame(spark, rows)
    assert {r["pur"]: r["depth"] for r in tree.depths(tree.resolved(df)).collect()} == walked(rows)
    assert {r["pur"]: r["size"] for r in tree.trees(tree.tree_nodes(df)).collect()} == {str(i): 7 - i for i in range(1, 7)}


def test_chain_of_two_thousand(spark):
    n = 2_000
    rows = [(str(i), str(i - 1) if i else "", "x", 1) for i in range(n)]
    random.Random(1).shuffle(rows)
    df, began = frame(spark, rows), time.time()
    assert {int(r["pur"]): r["depth"] for r in tree.depths(tree.resolved(df)).collect()} == {i: i + 1 for i in range(n)}
    nodes = tree.tree_nodes(df)
    assert {int(r["pur"]): (r["size"], r["height"]) for r in tree.trees(nodes).collect()} == {i: (n - i, n - i) for i in range(n)}
    assert tree.reveal(nodes, nodes.where("pur = '1234'")).count() == 1235
    assert time.time() - began < 240


@pytest.mark.parametrize("seed", [1, 2])
def test_random_filings_equal_walks(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        pur = "" if rng.random() < 0.03 else str(rng.randrange(i, i + 2))
        up = rng.choice([str(rng.randrange(120)), str(max(0, i - 1)), str(max(0, i - 1)), "", pur, "out"])
        rows.append((pur, up, "eliminated" if rng.random() < 0.08 else "x", 1))
    rows = list(dict.fromkeys(rows))
    got = {r["pur"]: r["depth"] for r in tree.depths(tree.resolved(frame(spark, rows))).collect()}
    assert got == walked(rows)


def test_siblings_by_grade_size_and_title(spark):
    rows = [("r", "", "x", 1), ("a", "r", "x", 1), ("b", "r", "x", 1), ("c", "r", "x", 1), ("d", "r", "x", 1), ("e", "c", "x", 1), ("s", "", "x", 1)]
    df = frame(spark, rows).withColumn("grade", F.when(F.col("pur").isin("c", "d", "b"), "low").otherwise("high"))
    got = {r["pur"]: r["sibling"] for r in tree.trees(tree.tree_nodes(df)).collect()}
    assert got == {"r": 1, "s": 2, "a": 1, "c": 2, "b": 3, "d": 4, "e": 1}


def test_closure_of_chains_cycles_and_diamonds(spark):
    assert lineage.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "pred string, succ string")).count() == 6
    assert lineage.closure(spark.createDataFrame([("a", "a")], "pred string, succ string")).count() == 0
    assert lineage.closure(spark.createDataFrame([], "pred string, succ string")).count() == 0
    chain = lineage.closure(spark.range(300).select(F.col("id").cast("string").alias("pred"), (F.col("id") + 1).cast("string").alias("succ")))
    assert chain.count() == 300 * 301 // 2
    rng = random.Random(4)
    edges = {(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(60)}
    want = set(edges)
    while True:
        grown = want | {(a, d) for a, b in want for c, d in edges if b == c}
        if grown == want:
            break
        want = grown
    got = {tuple(r) for r in lineage.closure(spark.createDataFrame(list(edges), "pred string, succ string")).collect()}
    assert got == {(a, b) for a, b in want if a != b}


def test_rounds_leave_nothing_behind(spark):
    import os

    from banderole import store

    before = len(store._made)
    tree.depths(tree.resolved(frame(spark, [(str(i), str(i - 1) if i else "", "x", 1) for i in range(64)]))).count()
    made = store._made[before:]
    assert len(made) > 5 and sum(os.path.exists(p.removeprefix("file://")) for p in made) <= 2
