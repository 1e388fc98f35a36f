"""Periods: which filing stands for an organisation in a period, and who filed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates


def with_period(df: DataFrame, grain: str) -> DataFrame:
    """Add period (key), period_label, period_end and period_year of ``date``."""
    p = dates.period(F.col("date"), grain)
    return df.withColumns({"period": p["key"], "period_label": p["label"], "period_end": p["end"], "period_year": p["year"]})


def ranked_filings(snapshots: DataFrame, grain: str) -> DataFrame:
    """Filings of an organisation in a period, ranked by headcount, then by date, latest first."""
    w = Window.partitionBy("org", "period").orderBy(F.desc("headcount"), F.desc("date"))
    return with_period(snapshots, grain).withColumn("place", F.row_number().over(w))


def chosen_filings(snapshots: DataFrame, grain: str) -> DataFrame:
    return ranked_filings(snapshots, grain).where("place = 1").drop("place")


def dropped_filings(snapshots: DataFrame, grain: str) -> DataFrame:
    return ranked_filings(snapshots, grain).where("place > 1")


def constant_scope(chosen: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Organisations that filed in every period of the range (relational division).

    The periods are those that any organisation filed in; their count is one number of a subquery.
    """
    at = chosen
    if first:
        at = at.where(F.col("period") >= first)
    if last:
        at = at.where(F.col("period") <= last)
    periods = at.agg(F.countDistinct("period").alias("all_periods"))
    per_org = at.groupBy("org").agg(F.countDistinct("period").alias("n_periods"))
    return per_org.join(F.broadcast(periods), F.col("n_periods") == F.col("all_periods")).select("org", "n_periods")


def best_window(chosen: DataFrame) -> DataFrame:
    """The window of periods with the most organisations x periods, the earliest such one.

    An organisation's runs of consecutive periods are islands; a window a..b counts the
    organisations with an island that covers it.  A best window ends where an island does, so for each first period the
    islands that hold it are added up from the latest end to the earliest.
    """
    axis = chosen.select("period").distinct().withColumn("i", F.row_number().over(Window.orderBy("period")))
    at = chosen.select("org", "period").distinct().join(axis, "period")
    island = F.col("i") - F.row_number().over(Window.partitionBy("org").orderBy("i"))
    runs = at.withColumn("island", island).groupBy("org", "island").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    counted = runs.groupBy("lo", "hi").agg(F.count("*").alias("n"))
    ends = counted.select(F.explode(F.sequence("lo", "hi")).alias("a"), F.col("hi").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").cast("long").alias("n"))
    scored = ends.withColumn("orgs", F.sum("n").over(Window.partitionBy("a").orderBy(F.desc("b")))).withColumn("score", F.col("orgs") * (F.col("b") - F.col("a") + 1))
    best = scored.orderBy(F.desc("score"), "a", "b").limit(1)
    first, last = axis.select(F.col("period").alias("first"), F.col("i").alias("a")), axis.select(F.col("period").alias("last"), F.col("i").alias("b"))
    return best.join(first, "a").join(last, "b").select("first", "last", "orgs", "score")


def out_of_window(snapshots: DataFrame, orgs: DataFrame) -> DataFrame:
    """Filings outside their organisation's validity."""
    inside = dates.live_at(F.col("valid_from"), F.col("valid_to"), F.col("date"))
    return snapshots.join(orgs.select("org", "valid_from", "valid_to"), "org").where(~inside)
