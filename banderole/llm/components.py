"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined map-side) and an equi-join whose large side Spark may
split, so a hub with any share of the edges never sits in one task; nothing but an edge count and
a checksum reaches the driver.  Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def connected_components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; a component's name is its least node.

    ``edges`` has columns u, v (long); loops, duplicates and both directions are allowed, rows with
    a null end are ignored.
    """
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = written(oriented, "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        star, between = written(_large_star(now), "large-star")
        after, new_path = written(_small_star(star), "edges")
        discard(path, between)
        last, state, now, path = state, _state(after), after, new_path
        if last == state:
            break
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
