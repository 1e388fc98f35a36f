"""The core query: a measure by group and period over the cube.

One scan joins the chosen filings and groups to a histogram (group, period, grade, bins); every
measure reads that histogram.  A pay measure is always a pair of bounds, never a midpoint.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..schema import BIN, THIN
from . import cube as cubes
from . import lineage, periods

POOLING = ("none", "family", "profession", "grade", "role", "tier")
QUANTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
RATES = ("headcount", "posts", "fte", "fte_known_rate", "disclosure_rate", "disclosed", "withheld", "vacant", "eliminated", "open_band")
BANDED = ("mean_pay", "mean_fte", "paybill", *QUANTILES)


@dataclass(frozen=True)
class Filter:
    """What to look at.  ``None`` leaves a dimension unfiltered."""

    orgs: tuple | None = None
    families: tuple | None = None
    grades: tuple | None = None
    profs: tuple | None = None
    ddat: bool | None = None
    policy: bool | None = None
    disclosure: str | None = None  # "disclosed" (banded) or "withheld"
    scs_grades: tuple | None = None
    tier: str = "A"  # "A", "B" or "AB"
    first: str | None = None
    last: str | None = None
    grain: str = "year"
    constant_scope: bool | None = None
    lineage: bool = True
    base_year: int | None = None

    def cells(self) -> Column:
        """The predicate on cube cells; it reaches the scan."""
        tests = [F.lit(True)]
        for column, values in (("grade", self.grades), ("prof", self.profs), ("grade", self.scs_grades)):
            if values is not None:
                tests.append(F.col(column).isin(*values))
        if self.ddat is not None:
            tests.append(F.col("ddat") == self.ddat)
        if self.policy is not None:
            tests.append(F.col("pol") == self.policy)
        if self.disclosure:
            tests.append(F.col("bin_low") >= 0 if self.disclosure == "disclosed" else F.col("bin_low") == -1)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def needs_prof(self, dimension: str) -> bool:
        """Whether the fine cube is needed; else the coarse one answers."""
        return dimension in ("profession", "role") or any(x is not None for x in (self.profs, self.ddat, self.policy))


def group_key(dimension: str, split_tier: bool) -> Column:
    key = {
        "none": F.lit("All"),
        "org": F.col("org"),
        "department": F.col("org"),
        "family": F.col("family"),
        "grade": F.col("grade"),
        "profession": F.col("prof") if dimension == "profession" else F.lit(""),
        "role": F.when(F.col("ddat"), "Digital").when(F.col("pol"), "Policy").otherwise("Other") if dimension == "role" else F.lit(""),
        "tier": F.col("tier"),
    }[dimension]
    return F.concat(key, F.lit("|"), F.col("tier")) if split_tier and dimension not in ("tier", "org", "department") else key


def in_range(df: DataFrame, f: Filter) -> DataFrame:
    if f.first:
        df = df.where(F.col("period") >= f.first)
    if f.last:
        df = df.where(F.col("period") <= f.last)
    return df


def scoped_filings(cube: DataFrame, orgs: DataFrame, f: Filter, dimension: str, edges: DataFrame | None = None) -> DataFrame:
    """Chosen filings after tier, selection, constant scope and lineage."""
    chosen = in_range(periods.chosen_filings(cubes.snapshots(cube), f.grain), f)
    wanted = orgs if f.tier == "AB" else orgs.where(F.col("tier") == f.tier)
    if f.families is not None:
        wanted = wanted.where(F.col("family").isin(*f.families))
    if f.orgs is not None:
        wanted = wanted.where(F.col("org").isin(*f.orgs))
    chosen = chosen.join(wanted.select("org", "family", "tier"), "org")
    if f.constant_scope:
        chosen = chosen.join(periods.constant_scope(chosen).select("org"), "org", "left_semi")
    if f.lineage and edges is not None and dimension in POOLING:
        out = lineage.exclusions(chosen, lineage.closure(edges), orgs).select("org", "period").distinct()
        chosen = chosen.join(out, ["org", "period"], "left_anti")
    return chosen


def grouped_cells(cube: DataFrame, filings: DataFrame, f: Filter, dimension: str) -> DataFrame:
    """The cells of the chosen filings that the filter keeps, with their group."""
    at = filings.select("org", "date", "family", "tier", "period", "period_end", "period_year")
    return cube.where(f.cells()).join(at, ["org", "date"]).withColumn("group_key", group_key(dimension, f.tier == "AB"))


def histogram(cube: DataFrame, filings: DataFrame, f: Filter, dimension: str, by_grade: bool = False) -> DataFrame:
    """(group_key, period[, grade], bin_low, bin_high) with summed measures."""
    keys = ["group_key", "period", "period_end", "period_year", *(["grade"] if by_grade else []), "bin_low", "bin_high"]
    return grouped_cells(cube, filings, f, dimension).groupBy(*keys).agg(*(F.sum(m).cast("long").alias(m) for m in cubes.MEASURES))


def filed(cube: DataFrame, filings: DataFrame, f: Filter, dimension: str) -> DataFrame:
    """(group_key, period, orgs_filed): organisations with a cell; counted apart, so that no sum carries sets of them."""
    each = grouped_cells(cube, filings, f, dimension).select("group_key", "period", "org").distinct()
    return each.groupBy("group_key", "period").agg(F.count("*").cast("int").alias("orgs_filed"))


def totals(hist: DataFrame) -> DataFrame:
    """(group_key, period) with headcount, banded counts and money."""
    banded = F.col("bin_low") >= 0
    add = lambda c, name, test=None: F.coalesce(F.sum(F.when(test, c) if test is not None else c), F.lit(0)).cast("long").alias(name)
    return hist.groupBy("group_key", "period", "period_end", "period_year").agg(
        add(F.col("n") + F.col("withheld"), "headcount"),
        *(add(F.col(m), m) for m in ("n", "withheld", "vacant", "eliminated", "fte100", "fte_known", "sum_floor", "sum_ceil", "bill_low", "bill_high")),
        add(F.col("n"), "open_band", F.col("bin_low") == -2),
        add(F.col("n"), "n_banded", banded),
        add(F.col("fte100"), "fte100_banded", banded),
    )


def _points(measure: str) -> Column:
    empty = (F.col("headcount") == 0) & (F.col("eliminated") == 0)
    value = {
        "headcount": F.col("headcount").cast("double"),
        "posts": (F.col("headcount") + F.col("eliminated")).cast("double"),
        "fte": F.floor(F.col("fte100") / 10 + 0.5) / 10,
        "fte_known_rate": F.try_divide("fte_known", "headcount"),
        "disclosure_rate": F.try_divide("n", "headcount"),
        **{m: F.col(c).cast("double") for m, c in (("disclosed", "n"), ("withheld", "withheld"), ("vacant", "vacant"), ("eliminated", "eliminated"), ("open_band", "open_band"))},
    }[measure]
    return F.when(~empty, value)


def _bounds(measure: str) -> tuple[Column, Column]:
    if measure == "mean_pay":
        return F.try_divide("sum_floor", "n_banded"), F.try_divide("sum_ceil", "n_banded")
    if measure == "mean_fte":
        return F.try_divide(F.col("bill_low") * 100, F.col("fte100_banded")), F.try_divide(F.col("bill_high") * 100, F.col("fte100_banded"))
    some = F.col("n_banded") > 0
    return F.when(some, F.col("bill_low").cast("double")), F.when(some, F.col("bill_high").cast("double"))


def weighted_bins(hist: DataFrame, weight: Column) -> DataFrame:
    """(group_key, period, side, bin, w): floor and ceiling histograms of banded cells."""
    sides = F.explode(F.array(F.struct(F.lit("lo").alias("side"), F.col("bin_low").alias("bin")), F.struct(F.lit("hi").alias("side"), F.col("bin_high").alias("bin"))))
    rows = hist.where("bin_low >= 0").withColumn("w", weight).select("group_key", "period", sides.alias("x"), "w")
    return rows.groupBy("group_key", "period", "x.side", "x.bin").agg(F.sum("w").alias("w"))


def quantiles(bins: DataFrame, which: dict[str, float] = QUANTILES) -> DataFrame:
    """Discrete weighted quantiles as bounds: the first bin whose running weight reaches q * total,
    else the last bin."""
    group = ["group_key", "period", "side"]
    w = Window.partitionBy(*group).orderBy("bin")
    run = bins.withColumns({"cum": F.sum("w").over(w), "total": F.sum("w").over(Window.partitionBy(*group))})
    picks = [F.coalesce(F.min(F.when(F.col("cum") >= q * F.col("total"), F.col("bin"))), F.max("bin")).alias(name) for name, q in which.items()]
    per_side = run.groupBy(*group).agg(*picks)
    low = lambda n: F.max(F.when(F.col("side") == "lo", F.col(n) * BIN)).cast("double").alias(f"{n}_lo")
    high = lambda n: F.max(F.when(F.col("side") == "hi", F.col(n) * BIN + BIN - 1)).cast("double").alias(f"{n}_hi")
    return per_side.groupBy("group_key", "period").agg(*(c for n in which for c in (low(n), high(n))))


def reweighted_bins(hist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bins weighted so that each grade counts by its headcount, and the covered share.

    ``hist`` is by grade.  Only grades with both headcount and banded posts can be weighted.
    """
    g = hist.groupBy("group_key", "period", "grade").agg(
        F.sum(F.col("n") + F.col("withheld")).alias("g_headcount"), F.sum(F.when(F.col("bin_low") >= 0, F.col("n")).otherwise(0)).alias("g_banded")
    )
    usable = (F.col("g_headcount") > 0) & (F.col("g_banded") > 0)
    covered = g.groupBy("group_key", "period").agg(
        F.try_divide(F.sum(F.when(usable, F.col("g_headcount")).otherwise(0)), F.sum("g_headcount")).alias("coverage")
    )
    weighted = hist.join(g.where(usable), ["group_key", "period", "grade"])
    return weighted_bins(weighted, F.col("n") * F.col("g_headcount") / F.col("g_banded")), covered


def deflate(df: DataFrame, cpi: DataFrame, base_year: int | None, money: list[str]) -> DataFrame:
    """Money columns in the base year's prices; a year without an index stays nominal and says so.

    A base year that the table lacks means no deflation at all.
    """
    last = F.col("base_year") == F.lit(base_year) if base_year else F.lit(True)
    base = cpi.withColumn("base_year", F.col("year")).where(last).agg(F.max_by("index", "year").alias("base_index"))
    out = df.join(F.broadcast(cpi.select(F.col("year").alias("period_year"), "index")), "period_year", "left").join(F.broadcast(base))
    factor = F.coalesce(F.try_divide("base_index", "index"), F.lit(1.0))
    out = out.withColumn("nominal", F.col("index").isNull() | F.col("base_index").isNull())
    return out.withColumns({c: F.col(c) * factor for c in money}).drop("index", "base_index")


def series(
    cube: DataFrame, orgs: DataFrame, f: Filter, measures: list[str], dimension: str = "none", *, edges: DataFrame | None = None, cpi: DataFrame | None = None, reweight: bool = False
) -> DataFrame:
    """One row per group and period: headcount, n, thin, disclosure_rate, orgs_filed and for each
    measure its value, or ``_lo`` and ``_hi``."""
    filings = scoped_filings(cube, orgs, f, dimension, edges)
    want = [m for m in measures if m in QUANTILES]
    hist = histogram(cube, filings, f, dimension, by_grade=reweight)
    t = totals(hist).join(filed(cube, filings, f, dimension), ["group_key", "period"])
    out = t
    for m in measures:
        if m in RATES:
            out = out.withColumn(m if m not in t.columns else f"{m}_value", _points(m))
        elif m not in QUANTILES:
            lo, hi = _bounds(m)
            out = out.withColumns({f"{m}_lo": lo, f"{m}_hi": hi})
    if want:
        bins, covered = reweighted_bins(hist) if reweight else (weighted_bins(hist, F.col("n").cast("double")), None)
        out = out.join(quantiles(bins, {m: QUANTILES[m] for m in want}), ["group_key", "period"], "left")
        if covered is not None:
            out = out.join(covered, ["group_key", "period"], "left")
    if cpi is not None:
        money = [f"{m}_{s}" for m in measures if m in BANDED for s in ("lo", "hi")]
        out = deflate(out, cpi, f.base_year, money)
    shown = F.col("n_banded") if any(m in BANDED for m in measures) else F.col("headcount")
    out = out.withColumns({"n_shown": shown, "thin": shown < THIN})
    return out if "disclosure_rate" in out.columns else out.withColumn("disclosure_rate", F.try_divide("n", "headcount"))


def dense(df: DataFrame, columns: list[str]) -> DataFrame:
    """All groups x all periods; what wasn't filed is null, not zero.  Both axes are small."""
    axis = df.select("group_key").distinct().join(F.broadcast(df.select("period").distinct()))
    return axis.join(df.select("group_key", "period", *columns), ["group_key", "period"], "left")


def count_above(cube: DataFrame, filings: DataFrame, f: Filter, threshold: Column, dimension: str = "none") -> DataFrame:
    """(group_key, period, certain, possible, total): a band is certainly above if its floor is,
    possibly if its ceiling is.  ``threshold`` may use period columns."""
    hist = histogram(cube, filings, replace(f, disclosure="disclosed"), dimension).withColumn("thr", threshold)
    n = lambda test, name: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long").alias(name)
    return hist.groupBy("group_key", "period").agg(n(F.col("bin_low") * BIN >= F.col("thr"), "certain"), n(F.col("bin_high") * BIN + BIN - 1 >= F.col("thr"), "possible"), F.sum("n").cast("long").alias("total"))


def as_of(df: DataFrame, table: DataFrame, year: str, value: str) -> DataFrame:
    """The table's value for the year, else for the latest earlier year, else for its last year.

    The table is small: it becomes one sorted array, broadcast and searched per row.
    """
    packed = table.agg(F.sort_array(F.collect_list(F.struct(F.col(year).alias("year"), F.col(value).alias("v")))).alias("t"))
    past = F.filter("t", lambda x: x["year"] <= F.col(year))
    pick = F.when(F.size(past) > 0, F.element_at(past, -1)).otherwise(F.element_at("t", -1))
    out = df.join(F.broadcast(packed)).withColumn("pick", pick)
    return out.withColumns({value: F.col("pick.v"), f"{value}_year": F.col("pick.year"), f"{value}_exact": F.col("pick.year") == F.col(year)}).drop("t", "pick")


def growth(df: DataFrame, value: str) -> DataFrame:
    """Per group: first, last, change in per cent and compound rate per year; null from nothing."""
    known = df.where(F.col(value).isNotNull())
    ends = known.groupBy("group_key").agg(*(f(F.struct("period_end", value)).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))))
    a, b = F.col(f"a.{value}"), F.col(f"b.{value}")
    years = dates.years_between(F.col("a.period_end"), F.col("b.period_end"))
    ok = (a > 0) & (b > 0) & (years > 0)
    return ends.select(
        "group_key",
        a.alias("first_value"),
        b.alias("last_value"),
        F.when(a > 0, (b / a - 1) * 100).alias("pct_change"),
        F.when(ok, (F.pow(b / a, 1 / years) - 1) * 100).alias("cagr"),
    )
