"""Predecessors and successors: transitive closure, and who must not be summed with whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..store import discard, written

_PAIR = ["ancestor", "descendant"]


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant) pairs over (pred, succ) edges, however many generations lie between them.

    Round k knows all pairs up to 2**k generations apart, and those that are exactly so many apart; joining the
    two doubles the reach, so a pair is found once a round and log2(generations) rounds suffice.  A round without a new
    pair ends it, also for cycles; nobody is its own ancestor.
    """
    step = edges.select(F.col("pred").alias("ancestor"), F.col("succ").alias("descendant")).dropna().distinct()
    (found, path), (apart, apart_path) = written(step, "closure"), written(step, "closure-apart")
    before = found.count()
    while before:
        longer = apart.select("ancestor", F.col("descendant").alias("at")).join(found.select(F.col("ancestor").alias("at"), "descendant"), "at").select(*_PAIR)
        (found, new_path), old = written(found.unionByName(longer).distinct(), "closure"), path
        path, now = new_path, found.count()
        discard(old)
        if now == before:
            break
        before = now
        twice = apart.select("ancestor", F.col("descendant").alias("at")).join(apart.select(F.col("ancestor").alias("at"), "descendant"), "at").select(*_PAIR).distinct()
        (apart, new_path), old = written(twice, "closure-apart"), apart_path
        apart_path = new_path
        discard(old)
    discard(apart_path)
    return found.where("ancestor <> descendant")


def exclusions(chosen: DataFrame, pairs: DataFrame, orgs: DataFrame) -> DataFrame:
    """(period, org) to leave out of pooled totals, with what was kept instead.

    For a filed organisation with filed descendants: the descendants go if only the ancestor was
    live at the period's end, else the ancestor goes.
    """
    spans = orgs.select("org", "valid_from", "valid_to")
    filed = chosen.select("org", "period", "period_end").join(spans, "org")
    live = dates.live_at(F.col("valid_from"), F.col("valid_to"), F.col("period_end"))
    filed = filed.select("org", "period", live.alias("live"))
    kids = filed.select(F.col("org").alias("kid"), "period", F.col("live").alias("kid_live"))
    of = filed.join(pairs, F.col("org") == F.col("ancestor"))
    tied = of.join(kids, (of["period"] == kids["period"]) & (F.col("kid") == F.col("descendant"))).drop(kids["period"])
    judged = tied.groupBy("period", "org", "live").agg(F.bool_or("kid_live").alias("any_kid_live"), F.sort_array(F.collect_set("kid")).alias("kids"))
    drop_kids = F.col("live") & ~F.col("any_kid_live")
    out = judged.select(
        "period",
        F.when(drop_kids, F.col("kids")).otherwise(F.array("org")).alias("dropped"),
        F.when(drop_kids, F.array("org")).otherwise(F.col("kids")).alias("kept_with"),
    )
    return out.select("period", F.explode("dropped").alias("org"), "kept_with")
