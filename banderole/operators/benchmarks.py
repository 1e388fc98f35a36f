"""Published pay tables: rows by code, statistics with their suppressions, regions, a price index or its stand-in, resources worth reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import suppressed_cell

LEAST_N = 30
KEPT = ("jobs", "median", "mean", "p25", "p75", "p90")
LEAST_POINTS = 5


def row_by_code(rows: DataFrame, code: str, place: str) -> DataFrame:
    """The first row, by ``place``, of each trimmed code; rows without one are left out."""
    c = F.trim(F.coalesce(F.col(code).cast("string"), F.lit("")))
    kept = [x for x in rows.columns if x != code]
    return rows.withColumn(code, c).where(F.col(code) != "").groupBy(code).agg(F.min_by(F.struct(*kept), place).alias("_x")).select(code, "_x.*")


def stats(cells: dict[str, Column], *, weekly: bool = False) -> Column:
    """struct of the kept statistics, n_known and suppressed (statistic to reason) of a row of published cells.

    Jobs are thousands to one place, and so are weekly amounts; others are whole.  A row of fewer than ``LEAST_N`` jobs has
    none of its amounts, whatever was published; a row without a job count keeps them and says so.
    """
    read = {k: suppressed_cell(cells[k]) for k in KEPT if k in cells}
    places = lambda k: 10 if k == "jobs" or weekly else 1
    value = {k: F.floor(c["value"] * places(k) + 0.5) / places(k) for k, c in read.items()}
    n = F.floor(value["jobs"] * 1000 + 0.5) if "jobs" in value else F.lit(None).cast("double")
    below = F.coalesce((n < LEAST_N) & value["median"].isNotNull(), F.lit(False)) if "median" in value else F.lit(False)
    gated = [(value[k] if k == "jobs" else F.when(~below, value[k])).cast("double").alias(k) for k in value]
    reasons = F.array(*(F.when(c["reason"].isNotNull(), F.struct(F.lit(k).alias("key"), c["reason"].alias("value"))) for k, c in read.items()), F.when(below, F.struct(F.lit("n_floor").alias("key"), F.lit(f"below-{LEAST_N}").alias("value"))))
    return F.struct(*gated, n.isNotNull().alias("n_known"), F.map_from_entries(F.array_compact(reasons)).alias("suppressed"))


def region_rows(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """``rows`` with the name of their ``region_idx``; an index without a name has a dash."""
    return rows.join(regions.select("region_idx", F.col("region").alias("_region")), "region_idx", "left").withColumn("region", F.coalesce("_region", F.lit("—"))).drop("_region", "region_idx")


def index_or(fetched: DataFrame, fallback: DataFrame, *, least: int = LEAST_POINTS) -> DataFrame:
    """(year, index, live): what was fetched if it has more than ``least`` points, else the stand-in.

    One window over few years decides; values that aren't positive numbers aren't points.
    """
    good = fetched.where((F.col("index") > 0) & ~F.isnan("index")).select("year", "index", F.lit(True).alias("live"))
    both = good.unionByName(fallback.select("year", "index", F.lit(False).alias("live")))
    whole = Window.partitionBy(F.lit(1))
    enough = F.count_if("live").over(whole) > least
    return both.withColumn("_enough", enough).where(F.col("live") == F.col("_enough")).drop("_enough")


def is_csv(url: Column, kind: Column) -> Column:
    return F.rlike(F.coalesce(url, F.lit("")), F.lit(r"(?i)\.csv(\?|$)")) | (F.upper(F.coalesce(kind, F.lit(""))) == "CSV")


def looks_senior(url: Column, name: Column) -> Column:
    """Whether a resource names the senior file; one that says junior anywhere never is."""
    said = F.lower(F.concat_ws(" ", F.coalesce(F.try_url_decode(url), url, F.lit("")), F.coalesce(name, F.lit(""))))
    return F.contains(said, F.lit("senior")) & ~F.contains(said, F.lit("junior"))


def tally(rows: DataFrame, *by: str, key: str) -> DataFrame:
    """(by, counts): a map from each value of ``key`` to its rows, nulls as the empty text; counted before values meet in a map."""
    counted = rows.groupBy(*by, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k")).agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_n")))).alias("counts"))  # one entry a value
