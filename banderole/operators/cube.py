"""The additive histogram cube: build at two grains, roll up, encode and decode.

All measures are whole numbers, so the coarse cube is exactly the sum of the fine one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import half_up
from ..schema import BIN

CORE = ["org", "date", "grade", "bin_low", "bin_high"]
PROF = [*CORE, "prof", "ddat", "pol"]
MEASURES = ["n", "withheld", "vacant", "eliminated", "fte100", "fte_known", "sum_floor", "sum_ceil", "bill_low", "bill_high", "open_band"]
RESIDUALS = ["bin_high_res", "fte_known_res", "fte_res", "sum_floor_res", "sum_ceil_res", "bill_low_res", "bill_high_res"]


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def _sum(test: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("long")


def measures() -> list[Column]:
    """Aggregates over post rows (status, disclosed, floor, ceil, fte).  An eliminated post counts
    as eliminated and nothing else; money needs both edges; bills leave vacant posts out."""
    gone = F.col("status") == "eliminated"
    here = ~gone
    vacant = F.col("status") == "vacant"
    banded = here & F.col("disclosed") & F.col("floor").isNotNull() & F.col("ceil").isNotNull()
    paid, part = banded & ~vacant, F.coalesce("fte", F.lit(1.0))
    return [
        _count(here & F.col("disclosed")).alias("n"),
        _count(here & ~F.col("disclosed")).alias("withheld"),
        _count(vacant).alias("vacant"),
        _count(gone).alias("eliminated"),
        _sum(here & F.col("fte").isNotNull(), half_up(F.col("fte") * 100)).alias("fte100"),
        _count(here & F.col("fte").isNotNull()).alias("fte_known"),
        _sum(banded, half_up(F.col("floor"))).alias("sum_floor"),
        _sum(banded, half_up(F.col("ceil"))).alias("sum_ceil"),
        _sum(paid, half_up(F.col("floor") * part)).alias("bill_low"),
        _sum(paid, half_up(F.col("ceil") * part)).alias("bill_high"),
        _count(here & F.col("disclosed") & (F.col("floor").isNull() != F.col("ceil").isNull())).alias("open_band"),
    ]


def build(posts: DataFrame, grain: list[str] = PROF) -> DataFrame:
    """The cube of post rows: one grouped pass, combined map-side."""
    return posts.groupBy(*grain).agg(*measures())


def roll_up(cube: DataFrame, grain: list[str] = CORE) -> DataFrame:
    """A coarser cube; exact, as every measure adds up."""
    return cube.groupBy(*grain).agg(*(F.sum(m).cast("long").alias(m) for m in MEASURES))


def grand_check(cube: DataFrame) -> DataFrame:
    """Both grains in one pass: grain, cells and every measure's total."""
    sets = cube.groupingSets([[F.col(c) for c in PROF], [F.col(c) for c in CORE]], *PROF).agg(
        F.grouping("prof").alias("coarse"), *(F.sum(m).alias(m) for m in MEASURES)
    )
    name = F.when(F.col("coarse") == 1, "core").otherwise("prof")
    return sets.groupBy(name.alias("grain")).agg(F.count("*").alias("cells"), *(F.sum(m).cast("long").alias(m) for m in MEASURES))


def encode(cube: DataFrame) -> DataFrame:
    """Structural and money columns as what their cell doesn't already say."""
    implied = lambda edge, c: F.when(F.col(edge) < 0, 0).otherwise(F.col("n") * c)
    return cube.withColumns(
        {
            "bin_high_res": F.col("bin_high") - F.col("bin_low"),
            "fte_known_res": F.col("fte_known") - (F.col("n") + F.col("withheld")),
            "fte_res": F.col("fte100") - 100 * F.col("fte_known"),
            "sum_floor_res": F.col("sum_floor") - implied("bin_low", F.col("bin_low") * BIN),
            "sum_ceil_res": F.col("sum_ceil") - implied("bin_high", F.col("bin_high") * BIN + BIN - 1),
            "bill_low_res": F.col("bill_low") - F.col("sum_floor"),
            "bill_high_res": F.col("bill_high") - F.col("sum_ceil"),
        }
    ).drop("bin_high", "fte_known", "fte100", "sum_floor", "sum_ceil", "bill_low", "bill_high")


def decode(encoded: DataFrame) -> DataFrame:
    """The inverse of ``encode``; later columns decode off earlier decoded ones."""
    out = encoded.withColumns({"bin_high": F.col("bin_low") + F.col("bin_high_res"), "fte_known": F.col("n") + F.col("withheld") + F.col("fte_known_res")})
    implied = lambda edge, c: F.when(F.col(edge) < 0, 0).otherwise(F.col("n") * c)
    out = out.withColumns(
        {
            "fte100": 100 * F.col("fte_known") + F.col("fte_res"),
            "sum_floor": F.col("sum_floor_res") + implied("bin_low", F.col("bin_low") * BIN),
            "sum_ceil": F.col("sum_ceil_res") + implied("bin_high", F.col("bin_high") * BIN + BIN - 1),
        }
    )
    out = out.withColumns({"bill_low": F.col("bill_low_res") + F.col("sum_floor"), "bill_high": F.col("bill_high_res") + F.col("sum_ceil")})
    return out.drop(*RESIDUALS)


def snapshots(cube: DataFrame) -> DataFrame:
    """(org, date) with headcount, disclosed and all rows."""
    return cube.groupBy("org", "date").agg(
        F.sum(F.col("n") + F.col("withheld")).cast("long").alias("headcount"),
        F.sum("n").cast("long").alias("disclosed"),
        F.sum(F.col("n") + F.col("withheld") + F.col("eliminated")).cast("long").alias("rows"),
    )
