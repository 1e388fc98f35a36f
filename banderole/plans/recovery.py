"""Market pages, archive recovery and occupation codes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import occupations, recovery
from ..sources import market_pages
from .stand_in import POSTS, posts, query, spread, table

# --- pages of job titles --------------------------------------------------------------------------
_PAGES = """p AS (SELECT p_partkey AS page_id, p_partkey % 7 AS kind, p_size * 100 + 1 AS n, CAST(floor(p_retailprice * 50) AS BIGINT) AS pay FROM part)"""


def _pages(spark, sf):
    """A page for each part: without the section, a table or a count for some."""
    kind, pay = F.col("p_partkey") % 7, F.floor(F.col("p_retailprice") * 50)
    n, pounds = F.format_number(F.col("p_size") * 100 + 1, 0), lambda x: F.concat(F.lit("&pound;"), F.format_number(x, 0))
    row = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c if not isinstance(c, str) else F.lit(c), F.lit("</td>")) for c in cells), F.lit("</tr>\n"))
    table_of = lambda first: F.concat(
        F.lit('<table class="summary" border="0">'), row("", "6 months to 15 Aug 2026", "Same period 2025", "Same period 2024"), first,
        row("Median annual salary (50<sup>th</sup> Percentile)", pounds(pay), "-", pounds(pay - 1000)), row("10<sup>th</sup> Percentile", F.when(kind == 3, "-").otherwise(pounds(pay - 2000)), "", ""),
        row("90th Percentile", pounds(pay + 2000), "", ""), row("Median annual salary again", "1", "1", "1"), F.lit("</table>"),
    )
    count = row("Number of salaries quoted", n, "0", "12")
    tables = F.when(kind == 1, "").otherwise(F.concat(table_of(F.when(kind == 2, F.lit("")).otherwise(count)), F.when(kind == 4, table_of(row("Number of salaries quoted", "77", "", ""))).otherwise("")))
    places = F.concat(
        F.lit('<table class="tab tabLocations"><tr><th>Location</th><th>Rank</th><th>Ads</th><th>Median</th></tr>'), row("London", "+1", "5", pounds(pay)), row("North West", "-2", "1,250", "-"), row("London", "+3", n, pounds(pay + 1)), F.lit("</table>")
    )
    head = F.concat(F.lit('<section id="headline_statistics" class="x"><p>The <b>median</b> salary in the UK is &pound;'), F.format_number(pay, 0), F.lit(" now.</p>"), tables, F.lit("</section>"))
    html = F.concat(F.lit('<html><section id="intro">x</section>'), F.when(kind == 0, "").otherwise(head), F.lit("<section>"), places, F.lit("</section></html>"))
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("page_id"), html.alias("html"))


@query(
    f"""WITH {_PAGES}, e AS (SELECT *, CASE kind WHEN 0 THEN 'no headline_statistics section' WHEN 1 THEN 'no summary table' WHEN 2 THEN 'summary table has no salary-count row' END AS error FROM p)
SELECT page_id, error, CASE WHEN error IS NULL THEN n END AS n, CASE WHEN error IS NULL THEN pay END AS median, CASE WHEN error IS NULL AND kind <> 3 THEN pay - 2000 END AS p10, CASE WHEN error IS NULL THEN pay + 2000 END AS p90,
  CASE WHEN error IS NULL THEN pay END AS prose_median, CASE WHEN error IS NULL THEN 0 END AS n_before, CASE WHEN error IS NULL THEN pay - 1000 END AS median_2_before, CASE WHEN kind = 4 THEN 77 END AS baseline_n,
  CASE WHEN error IS NULL THEN 6 END AS months, CASE WHEN error IS NULL THEN '2026-08-15' END AS window_end, CASE WHEN error IS NULL THEN 'Same period 2024' END AS oldest FROM e"""
)
def market_title_pages(spark, sf):
    t = F.col("title")
    now = market_pages.period(F.get(t["periods"], F.lit(0)))
    return market_pages.title_pages(_pages(spark, sf)).select(
        "page_id", "error", t["n"].alias("n"), t["median"].alias("median"), t["p10"].alias("p10"), t["p90"].alias("p90"), "prose_median", t["prior"][0]["n"].alias("n_before"), t["prior"][1]["median"].alias("median_2_before"),
        F.col("baseline")["n"].alias("baseline_n"), now["months"].alias("months"), now["window_end"].alias("window_end"), t["prior"][1]["label"].alias("oldest"),
    )


@query(f"WITH {_PAGES} SELECT page_id, 'london' AS place, n AS ads, pay + 1 AS median FROM p UNION ALL SELECT page_id, 'north west', 1250, NULL FROM p")
def market_places(spark, sf):
    return market_pages.places(_pages(spark, sf))


# --- recovery -------------------------------------------------------------------------------------
def _urls(spark, sf, keep: str, **columns):
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey")).where(keep)
    return o.select(F.concat(F.lit("u"), F.col("k").cast("string")).alias("url"), *(c.alias(name) for name, c in columns.items()))


@query(
    """WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
i AS (SELECT *, k % 2 = 0 AS f, k % 3 = 0 AND k % 9 <> 0 AS t, k % 5 = 0 AS a FROM o),
w AS (SELECT 'u' || k AS url, CASE WHEN f THEN 'Fail' WHEN k % 11 = 0 THEN 'Sibling' WHEN k % 7 = 0 THEN 'Source' WHEN t THEN 'Tried' ELSE 'ADHOC' END AS org,
  CASE WHEN f AND k % 6 <> 0 THEN d WHEN f THEN NULL WHEN k % 11 = 0 THEN '1999-01-01' WHEN k % 7 = 0 THEN '1998-01-01' WHEN t THEN d END AS date,
  CASE WHEN f THEN '404' WHEN t THEN 'previously-attempted' ELSE 'ad-hoc' END AS reason FROM i WHERE f OR t OR a)
SELECT * FROM w WHERE (date IS NULL OR date >= '1993-01-01') AND org <> 'Tried'"""
)
def recovery_work_list(spark, sf):
    text = F.lit(None).cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    failures = _urls(spark, sf, "k % 2 = 0", org=F.lit("Fail"), date=F.when(F.col("k") % 6 != 0, day), reason=F.lit("404"))
    tried = _urls(spark, sf, "k % 3 = 0", org=F.lit("Tried"), date=day, reason=text, kind=F.when(F.col("k") % 9 == 0, "pay-side"))
    asked = _urls(spark, sf, "k % 5 = 0", org=F.lit("ADHOC"), date=text, reason=F.lit("ad-hoc"))
    resources = _urls(spark, sf, "k % 7 = 0", org=F.lit("Source"), date=F.lit("1998-01-01"))
    siblings = _urls(spark, sf, "k % 11 = 0", org=F.lit("Sibling"), date=F.lit("1999-01-01"))
    items = recovery.work_list(failures, tried, asked, resources, siblings)
    return recovery.within(items, ["fail", "sibling", "source", "adhoc"], "1993-01-01")


@query(
    """WITH RECURSIVE w AS (SELECT c_custkey AS url, c_custkey AS spot, 0 AS hops FROM customer
  UNION ALL SELECT url, spot // 2, hops + 1 FROM w WHERE spot % 4 <> 0 AND spot % 5 <> 0 AND spot % 7 <> 0 AND spot % 11 <> 0 AND hops < 3),
l AS (SELECT url, max(hops) AS hops, arg_max(spot, hops) AS spot FROM w GROUP BY url)
SELECT 'http://x/' || url AS url, CASE WHEN spot % 4 = 0 AND spot IN (SELECT c_custkey FROM customer) THEN 'http://x/' || spot END AS origin, CASE WHEN spot % 4 = 0 AND spot IN (SELECT c_custkey FROM customer) THEN '20120101' END AS timestamp, hops,
  CASE WHEN spot % 4 = 0 AND spot IN (SELECT c_custkey FROM customer) THEN NULL WHEN hops = 0 AND spot % 5 = 0 THEN 'no-capture' ELSE 'only-redirects' END AS reason FROM l"""
)
def recovery_resolve(spark, sf):
    """Chases over a table of redirects: to half the key, to itself, into the archive, to nowhere."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    at = lambda x: F.concat(F.lit("http://x/"), x.cast("string"))
    urls = c.select(at(k).alias("url"))
    captures = c.where(k % 4 == 0).select(at(k).alias("url"), F.lit("20120101").alias("timestamp"))
    target = F.when(k % 7 == 0, at(k)).when(k % 11 == 0, "http://archive/x").otherwise(at(F.floor(k / 2)))
    return recovery.resolve(urls, captures, c.where(k % 5 != 0).select(at(k).alias("url"), target.alias("target")), inside=F.contains(F.col("target"), F.lit("//archive/")))


@query(
    """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'in-corpus' WHEN o_orderkey % 9 = 0 THEN 'dropped-by-ingest' ELSE 'not-yet-ingested' END AS downstream, CASE WHEN o_orderkey % 9 = 0 THEN 'later upload' END AS downstream_reason, count(*) AS n
FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL"""
)
def recovery_downstream(spark, sf):
    out = recovery.downstream(_urls(spark, sf, "k % 3 = 0"), _urls(spark, sf, "k % 2 = 0"), _urls(spark, sf, "k % 9 = 0", reason=F.lit("later upload")))
    return out.groupBy("downstream", "downstream_reason").agg(F.count("*").alias("n"))


@query("SELECT 'u' || o_orderkey AS url FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def recovery_not_ingested(spark, sf):
    return recovery.not_ingested(_urls(spark, sf, "k % 3 = 0"), _urls(spark, sf, "k % 2 = 0"))


# --- occupations ----------------------------------------------------------------------------------
def _listed(spark, *rows):
    return spark.createDataFrame(rows, "name string, code string, role string, confidence string")


@query(
    f"""WITH {POSTS}, c AS (SELECT CASE prof WHEN 'BUILDING' THEN '1133' WHEN 'MACHINERY' THEN '1137' ELSE CASE grade WHEN '1-URGENT' THEN '1111' END END AS code FROM posts)
SELECT code, CASE code WHEN '1133' THEN 'Works' WHEN '1137' THEN 'Machines' WHEN '1111' THEN 'Head' END AS role, CASE code WHEN '1133' THEN 'fact' WHEN '1137' THEN 'hypothesis' WHEN '1111' THEN 'hypothesis' END AS confidence, count(*) AS n FROM c GROUP BY ALL"""
)
def occupation_codes(spark, sf):
    """Posts by the occupation of their profession, or else of their grade."""
    professions = _listed(spark, ("BUILDING", "1133", "Works", "fact"), ("MACHINERY", "1137", "Machines", "hypothesis"))
    out = occupations.joined_by(posts(spark, sf).select("prof", "grade"), professions, _listed(spark, ("1-URGENT", "1111", "Head", "hypothesis")))
    return out.groupBy("code", "role", "confidence").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_mktsegment AS prof FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def professions_without_comparator(spark, sf):
    return occupations.without_comparator(posts(spark, sf), _listed(spark, ("BUILDING", "1133", "Works", "fact")))


@query(
    """WITH c AS (SELECT n_name AS role, CASE WHEN n_nationkey % 5 <> 4 THEN CAST(n_regionkey AS VARCHAR) END AS code, n_nationkey % 2 = 0 AS fact FROM nation)
SELECT role, code, CASE WHEN code <> '2' THEN CAST(code AS BIGINT) * 1000 END AS value, CASE WHEN code <> '2' THEN CASE WHEN fact THEN 'fact' ELSE 'hypothesis' END END AS confidence,
  CASE WHEN code IS NULL THEN 'no-crosswalk-entry' WHEN code = '2' THEN 'no-figure' END AS reason FROM c"""
)
def role_market_pay(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    code = F.col("n_regionkey").cast("string")
    crosswalk = n.where(F.col("n_nationkey") % 5 != 4).select(F.col("n_name").alias("role"), code.alias("code"), F.when(F.col("n_nationkey") % 2 == 0, "fact").otherwise("hypothesis").alias("confidence"))
    figures = r.where("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("code"), (F.col("r_regionkey") * 1000).cast("long").alias("value"), F.lit("fact").alias("confidence"))
    return occupations.market_pay(n.select(F.col("n_name").alias("role")), crosswalk, figures)


@query(
    f"""WITH {POSTS}, u AS (SELECT org, coalesce(CASE WHEN ordinal % 5 <> 0 THEN pur END, org) AS unit, count(*) AS posts, CAST(count(*) FILTER (WHERE disclosed) AS BIGINT) AS disclosed FROM posts p
  WHERE status <> 'eliminated' AND date = (SELECT max(date) FROM posts q WHERE q.org = p.org) GROUP BY ALL)
SELECT org, unit, posts, disclosed FROM u QUALIFY row_number() OVER (PARTITION BY org ORDER BY posts DESC, unit) <= 12"""
)
def largest_units(spark, sf):
    """The twelve largest units of each organisation's latest filing."""
    return occupations.latest_units(posts(spark, sf), F.col("org"), F.when(F.col("ordinal") % 5 != 0, F.col("pur")))
