"""Cube, period and series queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cube as cubes
from ..operators import lineage, periods
from ..operators import series as s
from ..schema import BIN
from ..store import once
from .stand_in import CUBE, MEASURES, POSTS, WITH_CUBE, chosen_sql, cut, posts, query, rounded, series_sql, table

def day():
    return F.col("date").cast("string").alias("date")


def cube_of(spark: SparkSession, sf: str, grain: list[str] = cubes.PROF) -> DataFrame:
    """The cube, written once: filings, totals and quantiles read it, the posts are read one time."""
    return once(cubes.build(posts(spark, sf), grain))


def orgs_of(spark: SparkSession, sf: str) -> DataFrame:
    """25 organisations with tier, family and validity: nation 3 ends and nation 4 begins in 1998."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    k = F.col("n_nationkey")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("org"),
        F.col("r_name").alias("family"),
        F.when(F.col("n_regionkey") < 3, "A").otherwise("B").alias("tier"),
        F.when(k % 5 == 4, F.lit("1998-01-01")).cast("date").alias("valid_from"),
        F.when(k % 5 == 3, F.lit("1997-12-31")).cast("date").alias("valid_to"),
    )


def edges_of(spark: SparkSession, sf: str) -> DataFrame:
    """Predecessor to successor: nation 5k+3 to 5k+4, and 5k to 5k+3."""
    n = table(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("pred"))
    b = n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("succ"))
    ends = a.withColumn("kb", F.when(F.col("ka") % 5 == 3, F.col("ka") + 1).when(F.col("ka") % 5 == 0, F.col("ka") + 3))
    return ends.join(F.broadcast(b), "kb").select("pred", "succ")


ORGS = """orgs AS (SELECT n_name AS org, n_nationkey AS k, CASE WHEN n_regionkey < 3 THEN 'A' ELSE 'B' END AS tier,
  CASE WHEN n_nationkey % 5 = 4 THEN DATE '1998-01-01' END AS valid_from, CASE WHEN n_nationkey % 5 = 3 THEN DATE '1997-12-31' END AS valid_to FROM nation)"""
EDGES = """edges AS (SELECT a.n_name AS pred, b.n_name AS succ FROM nation a JOIN nation b
  ON b.n_nationkey = CASE WHEN a.n_nationkey % 5 = 3 THEN a.n_nationkey + 1 WHEN a.n_nationkey % 5 = 0 THEN a.n_nationkey + 3 END)"""
CLOSURE = """pairs AS (SELECT pred AS ancestor, succ AS descendant FROM edges UNION SELECT a.pred, b.succ FROM edges a JOIN edges b ON a.succ = b.pred)"""


@query(f"""WITH {POSTS} SELECT post_id, bin_low, bin_high, CASE WHEN bin_low >= 0 THEN 'banded' WHEN bin_low = -2 THEN 'open' ELSE 'withheld' END AS band_state, withheld_reason FROM posts""")
def band_classify(spark, sf):
    from ..functions.classify import band_state

    return posts(spark, sf).select("post_id", "bin_low", "bin_high", band_state(F.col("bin_low")).alias("band_state"), "withheld_reason")


@query(f"WITH {POSTS} SELECT org, CAST(date AS VARCHAR) AS date, grade, bin_low, bin_high, {MEASURES} FROM posts GROUP BY org, date, grade, bin_low, bin_high")
def cube_core(spark, sf):
    return cubes.build(posts(spark, sf), cubes.CORE).withColumn("date", day())


@query(f"WITH {POSTS}, {CUBE} SELECT * EXCLUDE (family, tier) REPLACE (CAST(date AS VARCHAR) AS date) FROM cube")
def cube_prof(spark, sf):
    return cubes.build(posts(spark, sf)).withColumn("date", day())


_SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in cubes.MEASURES)


@query(f"""WITH {POSTS}, {CUBE}, core AS (SELECT org, date, grade, bin_low, bin_high, {MEASURES} FROM posts GROUP BY ALL)
SELECT 'prof' AS grain, count(*) AS cells, {_SUMS} FROM cube UNION ALL SELECT 'core', count(*), {_SUMS} FROM core""")
def cube_rollup_check(spark, sf):
    return cubes.grand_check(cubes.build(posts(spark, sf)))


@query(f"WITH {POSTS} SELECT org, CAST(date AS VARCHAR) AS date, grade, bin_low, bin_high, {MEASURES}, TRUE AS same FROM posts GROUP BY org, date, grade, bin_low, bin_high")
def cube_encode_decode(spark, sf):
    """Cells after encoding and decoding, with whether each equals the cell that went in."""
    core = cubes.build(posts(spark, sf), cubes.CORE)
    kept = core.withColumn("before", F.xxhash64(*cubes.CORE, *cubes.MEASURES))
    back = cubes.decode(cubes.encode(kept))
    return back.select(*cubes.CORE, *cubes.MEASURES, (F.xxhash64(*cubes.CORE, *cubes.MEASURES) == F.col("before")).alias("same")).withColumn("date", day())


@query(f"""WITH {POSTS}, days AS (SELECT DISTINCT date FROM posts)
SELECT CAST(date AS VARCHAR) AS date, year(date) || '-Q' || quarter(date) AS quarter, CAST(last_day(make_date(year(date), quarter(date) * 3, 1)) AS VARCHAR) AS quarter_end,
  year(date) || ' H' || CAST(ceil(month(date) / 6.0) AS INTEGER) AS half, CAST(year(date) AS VARCHAR) AS year, year(date) || '-12-31' AS year_end FROM days""")
def period_index(spark, sf):
    from ..functions.dates import period

    d = F.col("date")
    q, h, y = (period(d, g) for g in ("quarter", "half", "year"))
    days = posts(spark, sf).select("date").distinct()
    return days.select(day(), q["key"].alias("quarter"), q["end"].cast("string").alias("quarter_end"), h["label"].alias("half"), y["key"].alias("year"), y["end"].cast("string").alias("year_end"))


@query(f"{WITH_CUBE}, {chosen_sql('quarter', chr(39) + 'A' + chr(39) + ',' + chr(39) + 'B' + chr(39))} SELECT org, period, CAST(date AS VARCHAR) AS date, headcount FROM chosen")
def chosen_filing(spark, sf):
    return periods.chosen_filings(cubes.snapshots(cube_of(spark, sf)), "quarter").select("org", "period", day(), "headcount")


@query(f"{WITH_CUBE}, {chosen_sql('quarter')} SELECT org, period, CAST(date AS VARCHAR) AS date, headcount, CAST(place AS INTEGER) AS place FROM ranked WHERE place > 1")
def dropped_snapshots(spark, sf):
    return periods.dropped_filings(cubes.snapshots(cube_of(spark, sf)), "quarter").select("org", "period", day(), "headcount", "place")


@query(f"{WITH_CUBE} SELECT org, CAST(date AS VARCHAR) AS date, headcount, disclosed, row_count AS rows FROM snaps")
def snapshot_registry(spark, sf):
    return cubes.snapshots(cube_of(spark, sf)).withColumn("date", day())


@query(f"{WITH_CUBE} SELECT org, count(*) AS snapshots, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, CAST(sum(headcount) AS BIGINT) AS headcount, CAST(sum(disclosed) AS BIGINT) AS disclosed FROM snaps GROUP BY org")
def coverage_by_org(spark, sf):
    snaps = cubes.snapshots(cube_of(spark, sf))
    return snaps.groupBy("org").agg(
        F.count("*").alias("snapshots"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"), F.sum("headcount").alias("headcount"), F.sum("disclosed").alias("disclosed")
    )


YEARS = list(range(1995, 2002))


@query(f"{WITH_CUBE} SELECT org, {', '.join(f'CAST(count(*) FILTER (WHERE year(date) = {y}) AS BIGINT) AS y{y}' for y in YEARS)} FROM snaps GROUP BY org")
def coverage_matrix(spark, sf):
    snaps = cubes.snapshots(cube_of(spark, sf)).withColumn("year", F.year("date"))
    wide = snaps.groupBy("org").pivot("year", YEARS).count().na.fill(0)
    return wide.select("org", *(F.col(str(y)).alias(f"y{y}") for y in YEARS))


# --- series ---------------------------------------------------------------------------------------
def run(spark, sf, measures, f=s.Filter(), dimension="none", **kw) -> DataFrame:
    cube = cube_of(spark, sf, cubes.PROF if f.needs_prof(dimension) else cubes.CORE)
    return s.series(cube, orgs_of(spark, sf), f, measures, dimension, **kw)


@query(series_sql("group_key, period, headcount, CAST(headcount AS DOUBLE) AS value, orgs_filed"))
def series_headcount(spark, sf):
    return run(spark, sf, ["headcount"]).select("group_key", "period", "headcount", F.col("headcount_value").alias("value"), "orgs_filed")


@query(series_sql("group_key, period, CAST(headcount + eliminated AS DOUBLE) AS posts"))
def series_posts(spark, sf):
    return run(spark, sf, ["posts"]).select("group_key", "period", "posts")


@query(series_sql("group_key, period, floor(fte100 / 10.0 + 0.5) / 10 AS fte", group="c.family", grain="quarter"))
def series_fte(spark, sf):
    return run(spark, sf, ["fte"], s.Filter(grain="quarter"), "family").select("group_key", "period", "fte")


@query(series_sql(f"group_key, period, {cut('fte_known / headcount', 6)} AS fte_known_rate"))
def series_fte_known_rate(spark, sf):
    return run(spark, sf, ["fte_known_rate"]).select("group_key", "period", rounded("fte_known_rate", 6).alias("fte_known_rate"))


@query(series_sql(f"group_key, period, {cut('n / headcount', 6)} AS disclosure_rate, headcount < 30 AS thin", group="c.grade", grain="half"))
def series_disclosure_rate(spark, sf):
    return run(spark, sf, ["disclosure_rate"], s.Filter(grain="half"), "grade").select("group_key", "period", rounded("disclosure_rate", 6).alias("disclosure_rate"), "thin")


@query(series_sql("group_key, period, n AS disclosed, withheld, vacant, eliminated, open_band"))
def series_status_counts(spark, sf):
    return run(spark, sf, ["headcount"]).select("group_key", "period", F.col("n").alias("disclosed"), "withheld", "vacant", "eliminated", "open_band")


@query(series_sql(f"group_key, period, {cut('sum_floor / n_banded')} AS lo, {cut('sum_ceil / n_banded')} AS hi, n_banded AS n", group="c.family"))
def series_mean_pay(spark, sf):
    return run(spark, sf, ["mean_pay"], dimension="family").select("group_key", "period", rounded("mean_pay_lo").alias("lo"), rounded("mean_pay_hi").alias("hi"), F.col("n_banded").alias("n"))


@query(series_sql(f"group_key, period, {cut('bill_low * 100.0 / fte100_banded')} AS lo, {cut('bill_high * 100.0 / fte100_banded')} AS hi"))
def series_mean_fte(spark, sf):
    return run(spark, sf, ["mean_fte"]).select("group_key", "period", rounded("mean_fte_lo").alias("lo"), rounded("mean_fte_hi").alias("hi"))


@query(series_sql("group_key, period, CAST(bill_low AS DOUBLE) AS lo, CAST(bill_high AS DOUBLE) AS hi", grain="quarter"))
def series_paybill(spark, sf):
    return run(spark, sf, ["paybill"], s.Filter(grain="quarter")).select("group_key", "period", F.col("paybill_lo").alias("lo"), F.col("paybill_hi").alias("hi"))


def quantile_ctes(weight: str = "CAST(n AS DOUBLE)", source: str = "cells") -> str:
    return f""",
bins AS (SELECT group_key, period, 'lo' AS side, bin_low AS bin, sum({weight}) AS w FROM {source} WHERE bin_low >= 0 GROUP BY ALL
  UNION ALL SELECT group_key, period, 'hi', bin_high, sum({weight}) FROM {source} WHERE bin_low >= 0 GROUP BY ALL),
cums AS (SELECT *, sum(w) OVER (PARTITION BY group_key, period, side ORDER BY bin) AS cum, sum(w) OVER (PARTITION BY group_key, period, side) AS total FROM bins),
quant AS (SELECT group_key, period, side, {', '.join(f'coalesce(min(bin) FILTER (WHERE cum >= {q} * total), max(bin)) AS {n}' for n, q in s.QUANTILES.items())} FROM cums GROUP BY ALL)"""


def quantile_columns(names) -> str:
    return ", ".join(f"CAST(max({n}) FILTER (WHERE side = 'lo') * 5000 AS DOUBLE) AS {n}_lo, CAST(max({n}) FILTER (WHERE side = 'hi') * 5000 + 4999 AS DOUBLE) AS {n}_hi" for n in names)


@query(series_sql(f"group_key, period, {quantile_columns(['median'])}", group="c.grade", more=quantile_ctes(), tail="FROM quant GROUP BY group_key, period"))
def pay_median_band(spark, sf):
    """Flagship: the median band of each grade and year over the chosen filings."""
    return run(spark, sf, ["median"], dimension="grade").where("median_lo is not null").select("group_key", "period", "median_lo", "median_hi")


@query(series_sql(f"group_key, period, {quantile_columns(s.QUANTILES)}", group="c.family", more=quantile_ctes(), tail="FROM quant GROUP BY group_key, period"))
def series_quantiles(spark, sf):
    names = [f"{q}_{e}" for q in s.QUANTILES for e in ("lo", "hi")]
    return run(spark, sf, list(s.QUANTILES), dimension="family").where("median_lo is not null").select("group_key", "period", *names)


def _by(dimension, group, f=s.Filter(), tiers="'A'", cells="TRUE"):
    def go(spark, sf):
        return run(spark, sf, ["headcount", "disclosure_rate"], f, dimension).select("group_key", "period", "headcount", rounded("disclosure_rate", 6).alias("disclosure_rate"))

    return go, series_sql(f"group_key, period, headcount, {cut('n / headcount', 6)} AS disclosure_rate", group=group, tiers=tiers, cells=cells)


for _name, _args in {
    "series_by_family": ("family", "c.family"),
    "series_by_profession": ("profession", "c.prof"),
    "series_by_role_type": ("role", "CASE WHEN ddat THEN 'Digital' WHEN pol THEN 'Policy' ELSE 'Other' END"),
    "series_tier_split": ("grade", "c.grade || '|' || c.tier", s.Filter(tier="AB"), "'A','B'"),
    "series_filtered": ("none", "'All'", s.Filter(ddat=False, policy=None, grades=("1-URGENT", "2-HIGH"), disclosure="disclosed"), "'A'", "NOT ddat AND c.grade IN ('1-URGENT','2-HIGH') AND bin_low >= 0"),
}.items():
    _f, _sql = _by(*_args)
    _f.__name__ = _name
    query(_sql)(_f)

CPI = [(1995, 80.0), (1996, 82.0), (1997, 84.5), (1999, 88.0), (2000, 90.0), (2001, 92.5)]  # 1998 is missing
_CPI_SQL = f"cpi AS (SELECT * FROM (VALUES {', '.join(f'({y}, {v})' for y, v in CPI)}) AS t(year, idx))"


def cpi_of(spark) -> DataFrame:
    return spark.createDataFrame(CPI, "year int, index double")


@query(
    series_sql(
        f"group_key, period, {cut('sum_floor / n_banded * coalesce(92.5 / idx, 1)')} AS lo, {cut('sum_ceil / n_banded * coalesce(92.5 / idx, 1)')} AS hi, idx IS NULL AS nominal",
        more=f", {_CPI_SQL}",
        tail="FROM totals LEFT JOIN cpi ON CAST(period AS INTEGER) = cpi.year",
    )
)
def series_real_terms(spark, sf):
    out = run(spark, sf, ["mean_pay"], s.Filter(base_year=2001), cpi=cpi_of(spark))
    return out.select("group_key", "period", rounded("mean_pay_lo").alias("lo"), rounded("mean_pay_hi").alias("hi"), "nominal")


@query(series_sql(f"group_key, period, n_banded < 30 AS thin, CASE WHEN n_banded >= 30 THEN {cut('sum_floor / n_banded')} END AS lo", group="c.org || ''", grain="quarter"))
def series_thin_mask(spark, sf):
    out = run(spark, sf, ["mean_pay"], s.Filter(grain="quarter"), "org")
    return out.select("group_key", "period", "thin", F.when(~F.col("thin"), rounded("mean_pay_lo")).alias("lo"))


@query(
    series_sql(
        f"group_key, period, {quantile_columns(['median'])}, max(coverage) AS coverage",
        group="c.family",
        more=""",
grades AS (SELECT group_key, period, grade, sum(n + withheld) AS g_headcount, coalesce(sum(n) FILTER (WHERE bin_low >= 0), 0) AS g_banded FROM cells GROUP BY ALL),
cover AS (SELECT group_key, period, floor(coalesce(sum(g_headcount) FILTER (WHERE g_banded > 0), 0) / sum(g_headcount) * 1e6 + 0.5) / 1e6 AS coverage FROM grades GROUP BY ALL),
weighted AS (SELECT c.*, n * CAST(g_headcount AS DOUBLE) / g_banded AS gw FROM cells c JOIN grades g USING (group_key, period, grade) WHERE g_banded > 0 AND g_headcount > 0)"""
        + quantile_ctes("gw", "weighted"),
        tail="FROM quant JOIN cover USING (group_key, period) GROUP BY group_key, period",
    )
)
def series_reweighted(spark, sf):
    out = run(spark, sf, ["median"], dimension="family", reweight=True).where("median_lo is not null")
    return out.select("group_key", "period", "median_lo", "median_hi", rounded("coverage", 6).alias("coverage"))


_ALL = "'A','B'"


@query(f"""{WITH_CUBE}, {chosen_sql('quarter', _ALL)}, counted AS (SELECT org, count(DISTINCT period) AS n_periods FROM chosen GROUP BY org)
SELECT org, n_periods FROM counted WHERE n_periods = (SELECT count(DISTINCT period) FROM chosen)""")
def constant_scope(spark, sf):
    return periods.constant_scope(periods.chosen_filings(cubes.snapshots(cube_of(spark, sf)), "quarter"))


@query(f"""{WITH_CUBE}, {chosen_sql('date', _ALL)}, axis AS (SELECT period, row_number() OVER (ORDER BY period) AS i FROM (SELECT DISTINCT period FROM chosen)),
placed AS (SELECT org, i FROM chosen JOIN axis USING (period)), runs AS (SELECT org, min(i) AS lo, max(i) AS hi FROM (SELECT org, i, i - row_number() OVER (PARTITION BY org ORDER BY i) AS g FROM placed) GROUP BY org, g),
scored AS (SELECT a.period AS first, b.period AS last, a.i AS ai, b.i AS bi, count(*) AS orgs FROM axis a JOIN axis b ON a.i <= b.i JOIN runs r ON r.lo <= a.i AND r.hi >= b.i GROUP BY ALL)
SELECT first, last, CAST(orgs AS BIGINT) AS orgs, CAST(orgs * (bi - ai + 1) AS BIGINT) AS score FROM scored ORDER BY orgs * (bi - ai + 1) DESC, ai, bi LIMIT 1""")
def constant_scope_window(spark, sf):
    return periods.best_window(periods.chosen_filings(cubes.snapshots(cube_of(spark, sf)), "date"))


@query(f"WITH {EDGES}, {CLOSURE} SELECT ancestor, descendant FROM pairs")
def lineage_closure(spark, sf):
    return lineage.closure(edges_of(spark, sf))


_LIVE = "(coalesce({0}.valid_from <= {0}.period_end, TRUE) AND coalesce({0}.period_end <= {0}.valid_to, TRUE))"
_EXCLUDED = f"""filed AS (SELECT c.org, c.period, make_date(year(c.date), 12, 31) AS period_end, valid_from, valid_to FROM chosen c JOIN orgs USING (org)),
judged2 AS (SELECT f.period, f.org, {_LIVE.format('f')} AS live, k.org AS kid, {_LIVE.format('k')} AS kid_live FROM filed f JOIN pairs ON f.org = ancestor JOIN filed k ON k.org = descendant AND k.period = f.period),
verdict AS (SELECT period, org, live AND NOT bool_or(kid_live) AS drop_kids, list(kid) AS kids FROM judged2 GROUP BY period, org, live),
excluded AS (SELECT DISTINCT period, org FROM (SELECT period, unnest(CASE WHEN drop_kids THEN kids ELSE [org] END) AS org FROM verdict))"""


@query(f"{WITH_CUBE}, {ORGS}, {EDGES}, {CLOSURE}, {chosen_sql('year', _ALL)}, {_EXCLUDED} SELECT period, org FROM excluded")
def lineage_exclusions(spark, sf):
    chosen = periods.chosen_filings(cubes.snapshots(cube_of(spark, sf)), "year")
    return lineage.exclusions(chosen, lineage.closure(edges_of(spark, sf)), orgs_of(spark, sf)).select("period", "org").distinct()


@query(f"""{WITH_CUBE}, {ORGS}, {EDGES}, {CLOSURE}, {chosen_sql('year', _ALL)}, {_EXCLUDED},
kept AS (SELECT c.* FROM chosen c ANTI JOIN excluded e ON c.org = e.org AND c.period = e.period)
SELECT tier AS group_key, period, CAST(sum(headcount) AS BIGINT) AS headcount, CAST(count(*) AS INTEGER) AS orgs_filed FROM kept GROUP BY ALL""")
def series_lineage_safe(spark, sf):
    out = run(spark, sf, ["headcount"], s.Filter(tier="AB"), "tier", edges=edges_of(spark, sf))
    return out.select("group_key", "period", "headcount", "orgs_filed")


def _above(threshold: str) -> str:
    return f"""CAST(coalesce(sum(n) FILTER (WHERE bin_low * 5000 >= {threshold}), 0) AS BIGINT) AS certain, CAST(coalesce(sum(n) FILTER (WHERE bin_high * 5000 + 4999 >= {threshold}), 0) AS BIGINT) AS possible, CAST(sum(n) AS BIGINT) AS total"""


@query(series_sql(f"group_key, period, {_above('152000')}", group="c.family", cells="bin_low >= 0", tail="FROM cells GROUP BY group_key, period"))
def count_above_fixed(spark, sf):
    f, cube = s.Filter(), cube_of(spark, sf)
    return s.count_above(cube, s.scoped_filings(cube, orgs_of(spark, sf), f, "family"), f, F.lit(152_000), "family")


PM = [(1996, 101_000), (1998, 143_000), (2000, 152_500)]


@query(
    series_sql(
        f"group_key, period, {_above('thr')}",
        cells="bin_low >= 0",
        more=f""", pm AS (SELECT * FROM (VALUES {', '.join(map(str, PM))}) AS t(year, pay)),
dated AS (SELECT *, coalesce((SELECT arg_max(pay, year) FROM pm WHERE year <= CAST(period AS INTEGER)), (SELECT arg_max(pay, year) FROM pm)) AS thr FROM cells)""",
        tail="FROM dated GROUP BY group_key, period",
    )
)
def count_above_yearly(spark, sf):
    f, cube = s.Filter(), cube_of(spark, sf)
    filings = s.scoped_filings(cube, orgs_of(spark, sf), f, "none")
    pm = spark.createDataFrame(PM, "year int, pay long")
    years = s.as_of(filings.select("period_year").distinct(), pm.withColumnRenamed("year", "period_year"), "period_year", "pay")
    hist = s.histogram(cube, filings, s.Filter(disclosure="disclosed"), "none").join(F.broadcast(years.select("period_year", "pay")), "period_year")
    n = partial(lambda test, name: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long").alias(name))
    return hist.groupBy("group_key", "period").agg(
        n(F.col("bin_low") * BIN >= F.col("pay"), "certain"), n(F.col("bin_high") * BIN + BIN - 1 >= F.col("pay"), "possible"), F.sum("n").cast("long").alias("total")
    )


@query(series_sql(f"group_key, period, {cut('headcount / sum(headcount) OVER (PARTITION BY period)', 6)} AS share", group="c.grade"))
def grade_mix_share(spark, sf):
    from pyspark.sql import Window

    out = run(spark, sf, ["headcount"], dimension="grade")
    return out.select("group_key", "period", rounded(F.col("headcount") / F.sum("headcount").over(Window.partitionBy("period")), 6).alias("share"))


_TOP4 = """, latest AS (SELECT org, arg_max(headcount, period) AS v FROM chosen GROUP BY org), top4 AS (SELECT org FROM latest ORDER BY v DESC, org LIMIT 4),
regroup AS (SELECT * REPLACE (CASE WHEN org IN (SELECT org FROM top4) THEN org ELSE 'Other' END AS group_key) FROM cells)"""


@query(series_sql(f"group_key, period, {quantile_columns(['median'])}", more=_TOP4 + quantile_ctes(source="regroup"), tail="FROM quant GROUP BY group_key, period"))
def other_requery_top4(spark, sf):
    """The four organisations with the most posts in their latest year, the rest as a group of its own."""
    f, cube = s.Filter(), cube_of(spark, sf)
    filings = s.scoped_filings(cube, orgs_of(spark, sf), f, "org")
    top = filings.groupBy("org").agg(F.max_by("headcount", "period").alias("v")).orderBy(F.desc("v"), "org").limit(4).select("org", F.col("org").alias("bucket"))
    named = filings.join(F.broadcast(top), "org", "left").withColumn("family", F.coalesce("bucket", F.lit("Other")))
    hist = s.histogram(cube, named, f, "family")
    return s.quantiles(s.weighted_bins(hist, F.col("n").cast("double")), {"median": 0.5})


@query(
    series_sql(
        f"group_key, {cut('first_value')} AS first_value, {cut('last_value')} AS last_value, {cut('(last_value / first_value - 1) * 100', 4)} AS pct_change",
        group="c.family",
        more=", ends AS (SELECT group_key, arg_min(sum_floor / n_banded, period) AS first_value, arg_max(sum_floor / n_banded, period) AS last_value FROM totals GROUP BY group_key)",
        tail="FROM ends",
    )
)
def series_growth(spark, sf):
    g = s.growth(run(spark, sf, ["mean_pay"], dimension="family"), "mean_pay_lo")
    return g.select("group_key", rounded("first_value").alias("first_value"), rounded("last_value").alias("last_value"), rounded("pct_change", 4).alias("pct_change"))


@query(series_sql("a.group_key, b.period, t.headcount", group="c.org || ''", grain="quarter", tail="FROM (SELECT DISTINCT group_key FROM totals) a CROSS JOIN (SELECT DISTINCT period FROM totals) b LEFT JOIN totals t ON t.group_key = a.group_key AND t.period = b.period"))
def series_dense_axis(spark, sf):
    return s.dense(run(spark, sf, ["headcount"], s.Filter(grain="quarter"), "org"), ["headcount"])
