"""Lists of high earners: threshold series per edition, gaps and breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_series(rows: DataFrame, thresholds: list[int]) -> DataFrame:
    """(edition, threshold, listed, certain, possible, not_published): a missing ceiling is the floor."""
    high = F.coalesce("hi", "lo")
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    long = rows.select("edition", "lo", high.alias("high"), t)
    return long.groupBy("edition", "threshold").agg(
        F.count("*").alias("listed"),
        F.count_if(F.col("lo") >= F.col("threshold")).alias("certain"),
        F.count_if(F.col("lo").isNotNull() & (F.col("high") >= F.col("threshold"))).alias("possible"),
        F.count_if(F.col("lo").isNull()).alias("not_published"),
    )


def by_type(rows: DataFrame) -> DataFrame:
    """(edition, by_type): map of organisation type to count; a blank type is a key of its own."""
    kind = F.when(F.coalesce("org_type", F.lit("")) == "", "(not published)").otherwise(F.col("org_type"))
    counted = rows.groupBy("edition", kind.alias("kind")).agg(F.count("*").alias("n"))
    return counted.groupBy("edition").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("by_type"))


def gaps(editions: DataFrame, month: int = 9, day: int = 30) -> DataFrame:
    """Yearly reference dates between the first and last edition that have none; never filled in."""
    ends = editions.agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b"))
    due = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year")).select("year", F.make_date("year", F.lit(month), F.lit(day)).alias("date"))
    return due.join(editions.select(F.year("date").alias("year")).distinct(), "year", "left_anti")


def breaks(editions: DataFrame, column: str) -> DataFrame:
    """Editions where a property (threshold, schema, reference month) differs from the one before."""
    w = Window.orderBy("date")  # one row per edition
    marked = editions.withColumns({"before": F.lag(column).over(w), "nth": F.row_number().over(w)})
    return marked.where((F.col("nth") > 1) & ~F.col(column).eqNullSafe(F.col("before"))).select("date", "before", F.col(column).alias("after"))
