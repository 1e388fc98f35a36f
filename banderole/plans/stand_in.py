"""The driver's tables seen through the engine's data model: an order is a published post."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import BIN, PLAUSIBLE, band_bins, positive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows in as many partitions as a shuffle has: a small file of keys is one split, whatever is drawn from them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def posts(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    df = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    key, edge = F.col("o_orderkey"), F.floor(F.col("o_totalprice") / BIN) * BIN
    shown = key % 3 != 0
    lo = F.when(shown, positive(edge)).cast("double")
    hi = F.when(shown & (key % 41 != 1), edge + BIN - 1).cast("double")
    odd = (F.coalesce(hi, lo) < PLAUSIBLE[0]) | (F.coalesce(lo, hi) > PLAUSIBLE[1])
    reason = F.when(lo.isNull() & hi.isNull(), "N/A").when(odd, "implausible")
    low, high = band_bins(F.when(reason.isNull(), lo), F.when(reason.isNull(), hi))
    day = F.col("o_orderdate").cast("date")
    return df.select(
        key.alias("post_id"),
        F.col("n_name").alias("org"),
        F.col("r_name").alias("family"),
        F.when(F.col("n_regionkey") < 3, "A").otherwise("B").alias("tier"),
        F.last_day(day).alias("date"),
        day.alias("order_date"),
        F.col("o_orderpriority").alias("grade"),
        F.col("c_mktsegment").alias("prof"),
        (F.col("c_mktsegment") == "MACHINERY").alias("ddat"),
        (F.col("c_mktsegment") == "BUILDING").alias("pol"),
        F.when(key % 29 == 5, "eliminated").when(key % 31 == 7, "vacant").otherwise("filled-named").alias("status"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, 0.5).otherwise(1.0).cast("double").alias("fte"),
        lo.alias("floor"),
        hi.alias("ceil"),
        reason.isNull().alias("disclosed"),
        reason.alias("withheld_reason"),
        low.alias("bin_low"),
        high.alias("bin_high"),
        F.col("o_custkey").cast("string").alias("pur"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("unit"),
        F.when(key % 4 != 0, F.concat(F.when(key % 2 == 0, "Holder ").otherwise("HOLDER "), F.element_at(F.array(*map(F.lit, ("Ash", "Birch", "Cedar", "Elm", "Fir"))), (key % 5 + 1).cast("int")))).alias("holder"),
        key.alias("ordinal"),
    )


POSTS = """
raw AS (
  SELECT o_orderkey AS post_id, n_name AS org, r_name AS family, CASE WHEN n_regionkey < 3 THEN 'A' ELSE 'B' END AS tier,
    last_day(CAST(o_orderdate AS DATE)) AS date, CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS grade, c_mktsegment AS prof,
    c_mktsegment = 'MACHINERY' AS ddat, c_mktsegment = 'BUILDING' AS pol,
    CASE WHEN o_orderkey % 29 = 5 THEN 'eliminated' WHEN o_orderkey % 31 = 7 THEN 'vacant' ELSE 'filled-named' END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 1.0 END AS fte,
    CASE WHEN o_orderkey % 3 <> 0 AND floor(o_totalprice / 5000) > 0 THEN floor(o_totalprice / 5000) * 5000 END AS floor,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 41 <> 1 THEN floor(o_totalprice / 5000) * 5000 + 4999 END AS ceil,
    CAST(o_custkey AS VARCHAR) AS pur, o_orderpriority AS title, o_orderstatus AS unit, o_orderkey AS ordinal,
    CASE WHEN o_orderkey % 4 <> 0 THEN (CASE WHEN o_orderkey % 2 = 0 THEN 'Holder ' ELSE 'HOLDER ' END) || (['Ash', 'Birch', 'Cedar', 'Elm', 'Fir'])[o_orderkey % 5 + 1] END AS holder
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
judged AS (
  SELECT *, CASE WHEN floor IS NULL AND ceil IS NULL THEN 'N/A' WHEN coalesce(ceil, floor) < 30000 OR coalesce(floor, ceil) > 800000 THEN 'implausible' END AS withheld_reason
  FROM raw),
posts AS (
  SELECT *, withheld_reason IS NULL AS disclosed,
    CAST(CASE WHEN withheld_reason IS NOT NULL THEN -1 WHEN floor IS NULL OR ceil IS NULL THEN -2 ELSE floor(floor / 5000) END AS INTEGER) AS bin_low,
    CAST(CASE WHEN withheld_reason IS NOT NULL THEN -1 WHEN floor IS NULL OR ceil IS NULL THEN -2 ELSE floor(ceil / 5000) END AS INTEGER) AS bin_high
  FROM judged)"""

MEASURES = """
  CAST(count(*) FILTER (WHERE status <> 'eliminated' AND disclosed) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE status <> 'eliminated' AND NOT disclosed) AS BIGINT) AS withheld,
  CAST(count(*) FILTER (WHERE status = 'vacant') AS BIGINT) AS vacant,
  CAST(count(*) FILTER (WHERE status = 'eliminated') AS BIGINT) AS eliminated,
  CAST(coalesce(sum(floor(fte * 100 + 0.5)) FILTER (WHERE status <> 'eliminated'), 0) AS BIGINT) AS fte100,
  CAST(count(fte) FILTER (WHERE status <> 'eliminated') AS BIGINT) AS fte_known,
  CAST(coalesce(sum(floor) FILTER (WHERE status <> 'eliminated' AND bin_low >= 0), 0) AS BIGINT) AS sum_floor,
  CAST(coalesce(sum(ceil) FILTER (WHERE status <> 'eliminated' AND bin_low >= 0), 0) AS BIGINT) AS sum_ceil,
  CAST(coalesce(sum(floor(floor * coalesce(fte, 1) + 0.5)) FILTER (WHERE status = 'filled-named' AND bin_low >= 0), 0) AS BIGINT) AS bill_low,
  CAST(coalesce(sum(floor(ceil * coalesce(fte, 1) + 0.5)) FILTER (WHERE status = 'filled-named' AND bin_low >= 0), 0) AS BIGINT) AS bill_high,
  CAST(count(*) FILTER (WHERE status <> 'eliminated' AND bin_low = -2) AS BIGINT) AS open_band"""

CUBE = f"cube AS (SELECT org, family, tier, date, grade, bin_low, bin_high, prof, ddat, pol, {MEASURES} FROM posts GROUP BY ALL)"
SNAPSHOTS = """snaps AS (SELECT org, family, tier, date, CAST(sum(n + withheld) AS BIGINT) AS headcount, CAST(sum(n) AS BIGINT) AS disclosed,
  CAST(sum(n + withheld + eliminated) AS BIGINT) AS row_count FROM cube GROUP BY ALL)"""


def chosen_sql(grain: str = "year", tiers: str = "'A'", where: str = "TRUE") -> str:
    key = {
        "year": "CAST(year(date) AS VARCHAR)",
        "half": "year(date) || '-H' || CAST(ceil(month(date) / 6.0) AS INTEGER)",
        "quarter": "year(date) || '-Q' || quarter(date)",
        "date": "CAST(date AS VARCHAR)",
    }[grain]
    return f"""ranked AS (SELECT *, {key} AS period, row_number() OVER (PARTITION BY org, {key} ORDER BY headcount DESC, date DESC) AS place FROM snaps),
chosen AS (SELECT * FROM ranked WHERE place = 1 AND tier IN ({tiers}) AND {where})"""


WITH_CUBE = f"WITH {POSTS},\n{CUBE},\n{SNAPSHOTS}"
TOTALS = """CAST(sum(n + withheld) AS BIGINT) AS headcount, CAST(sum(n) AS BIGINT) AS n, CAST(sum(withheld) AS BIGINT) AS withheld, CAST(sum(vacant) AS BIGINT) AS vacant,
  CAST(sum(eliminated) AS BIGINT) AS eliminated, CAST(sum(fte100) AS BIGINT) AS fte100, CAST(sum(fte_known) AS BIGINT) AS fte_known,
  CAST(sum(sum_floor) AS BIGINT) AS sum_floor, CAST(sum(sum_ceil) AS BIGINT) AS sum_ceil, CAST(sum(bill_low) AS BIGINT) AS bill_low, CAST(sum(bill_high) AS BIGINT) AS bill_high,
  CAST(coalesce(sum(n) FILTER (WHERE bin_low = -2), 0) AS BIGINT) AS open_band, CAST(coalesce(sum(n) FILTER (WHERE bin_low >= 0), 0) AS BIGINT) AS n_banded,
  CAST(coalesce(sum(fte100) FILTER (WHERE bin_low >= 0), 0) AS BIGINT) AS fte100_banded, CAST(count(DISTINCT org) AS INTEGER) AS orgs_filed"""


def series_sql(select: str, group: str = "'All'", grain: str = "year", tiers: str = "'A'", cells: str = "TRUE", where: str = "TRUE", more: str = "", tail: str = "FROM totals") -> str:
    """SQL of one series: chosen filings, cells in them, totals by group and period."""
    return f"""{WITH_CUBE},
{chosen_sql(grain, tiers, where)},
cells AS (SELECT c.*, h.period, {group} AS group_key FROM cube c JOIN chosen h ON c.org = h.org AND c.date = h.date WHERE {cells}),
totals AS (SELECT group_key, period, {TOTALS} FROM cells GROUP BY group_key, period){more}
SELECT {select} {tail}"""


def cut(x: str, dp: int = 2) -> str:
    """SQL that rounds half up to ``dp`` places."""
    return f"floor(({x}) * {10**dp} + 0.5) / {10**dp}"


def rounded(c, dp: int = 2):
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10**dp + 0.5) / 10**dp
