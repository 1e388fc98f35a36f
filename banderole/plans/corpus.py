"""Corpus facts, archived captures, claims and rolls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus
from ..operators import series as s
from .pay import cube_of, orgs_of, run
from .stand_in import WITH_CUBE, cut, posts, query, rounded, series_sql, table

ORGS = """orgs AS (SELECT n_name AS org, n_nationkey AS k, CASE WHEN n_nationkey % 5 = 4 THEN DATE '1998-01-01' END AS valid_from, CASE WHEN n_nationkey % 5 = 3 THEN DATE '1997-12-31' END AS valid_to FROM nation)"""


@query(
    f"""{WITH_CUBE} SELECT count(DISTINCT org) AS orgs, count(DISTINCT (org, date)) AS snapshots, count(DISTINCT date) AS dates, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(*) AS cells,
  CAST(sum(n) AS BIGINT) AS disclosed, CAST(sum(withheld) AS BIGINT) AS withheld, CAST(sum(vacant) AS BIGINT) AS vacant, CAST(sum(eliminated) AS BIGINT) AS eliminated, CAST(sum(open_band) AS BIGINT) AS open_band,
  CAST(sum(n + withheld + eliminated) AS BIGINT) AS posts, CAST(sum(n + withheld) AS BIGINT) AS headcount, floor(sum(n) * 1000.0 / sum(n + withheld) + 0.5) / 1000 AS disclosure_rate FROM cube"""
)
def corpus_stats(spark, sf):
    out = corpus.stats(cube_of(spark, sf))
    return out.withColumns({d: F.col(d).cast("string") for d in ("first_date", "last_date")})


@query(series_sql(f"period, {cut('sum(headcount) FILTER (WHERE group_key IN (' + chr(39) + 'BUILDING' + chr(39) + ', ' + chr(39) + 'FURNITURE' + chr(39) + ')) / sum(headcount)', 6)} AS share", group="c.prof", tail="FROM totals GROUP BY period"))
def unclassified_share(spark, sf):
    """The part of each year's headcount in professions that say little."""
    return corpus.share_of(run(spark, sf, ["headcount"], dimension="profession"), ["BUILDING", "FURNITURE"]).withColumn("share", rounded("share", 6))


_ENDS = f""", rates AS (SELECT group_key, {cut('n / headcount', 6)} AS rate FROM totals WHERE headcount >= 30 AND period = (SELECT max(period) FROM totals WHERE headcount > 0))"""
_BY = "SELECT {} FROM rates ORDER BY rate {}, group_key {} LIMIT 1"


@query(
    series_sql(
        "count(*) AS groups, " + ", ".join(f"CASE WHEN count(*) >= 2 THEN ({_BY.format(x, way, way)}) END AS {end}_{name}" for end, way in (("low", "ASC"), ("high", "DESC")) for name, x in (("group", "group_key"), ("rate", "rate"))),
        group="c.grade", more=_ENDS, tail="FROM rates",
    )
)
def grade_rate_extremes(spark, sf):
    """The grades with the lowest and the highest disclosure rate in the latest year."""
    rates = run(spark, sf, ["disclosure_rate"], dimension="grade")
    return corpus.rate_extremes(rates.withColumn("disclosure_rate", rounded("disclosure_rate", 6)), "disclosure_rate")


@query(series_sql("group_key, min(period) AS first_period, max(period) AS last_period, arg_max(headcount, period) AS latest", group="c.org || ''", grain="quarter", tail="FROM totals WHERE headcount > 0 GROUP BY group_key"))
def populated_periods(spark, sf):
    return corpus.populated(run(spark, sf, ["headcount"], s.Filter(grain="quarter"), "org"))


@query(series_sql("group_key, period, headcount, lag(headcount) OVER w AS before, headcount - lag(headcount) OVER w AS change", group="c.family", tail="FROM totals WINDOW w AS (PARTITION BY group_key ORDER BY period)"))
def previous_period(spark, sf):
    out = corpus.against_previous(run(spark, sf, ["headcount"], dimension="family"), "headcount")
    return out.select("group_key", "period", "headcount", "before", "change")


GRADES = ["1-URGENT", "3-MEDIUM", "2-HIGH"]


@query("SELECT DISTINCT o_orderpriority AS value, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END AS place FROM orders")
def canonical_order(spark, sf):
    return corpus.in_order(posts(spark, sf), "grade", GRADES)


_BUILDS = "b AS (SELECT n_name AS org, o_orderpriority AS grade, o_orderdate AS day, o_clerk FROM (SELECT *, o_orderkey AS o_clerk FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query(
    f"""WITH {_BUILDS}, was AS (SELECT * FROM b WHERE day < TIMESTAMP '1998-01-01'), now AS (SELECT * FROM b WHERE day >= TIMESTAMP '1998-01-01' AND o_clerk % 7 = 0 AND org > 'C' AND grade <> '5-LOW')
SELECT 'org' AS dictionary, org AS value FROM was WHERE org NOT IN (SELECT org FROM now) GROUP BY org UNION ALL SELECT 'grade', grade FROM was WHERE grade NOT IN (SELECT grade FROM now) GROUP BY grade"""
)
def dict_loss(spark, sf):
    """Values of two dictionaries that a smaller, later build no longer has."""
    p = posts(spark, sf)
    after = p.where((F.col("order_date") >= "1998-01-01") & (F.col("post_id") % 7 == 0) & (F.col("org") > "C") & (F.col("grade") != "5-LOW"))
    return corpus.dictionary_loss(p.where(F.col("order_date") < "1998-01-01"), after, ["org", "grade"])


@query(
    f"""{WITH_CUBE}, r AS (SELECT org, sum(n) FILTER (WHERE year(date) = 1996) / sum(n + withheld) FILTER (WHERE year(date) = 1996) AS was, sum(n) FILTER (WHERE year(date) = 1997) / sum(n + withheld) FILTER (WHERE year(date) = 1997) AS now FROM cube GROUP BY org)
SELECT org, {cut('was', 6)} AS was, {cut('now', 6)} AS "is", {cut('now - was', 6)} AS moved FROM r WHERE abs(now - was) >= 0.02"""
)
def rate_moves(spark, sf):
    cube = cube_of(spark, sf)
    out = corpus.rate_moves(cube.where(F.year("date") == 1996), cube.where(F.year("date") == 1997), ["org"], 0.02)
    return out.select("org", *(rounded(c, 6).alias(c) for c in ("was", "is", "moved")))


@query(f"WITH {ORGS} SELECT org FROM orgs WHERE coalesce(valid_from <= DATE '1996-06-30', TRUE) AND coalesce(valid_to >= DATE '1999-06-30', TRUE)")
def live_between(spark, sf):
    return corpus.live_between(orgs_of(spark, sf), "1996-06-30", "1999-06-30").select("org")


@query(
    f"""WITH {ORGS}, claims AS (SELECT 'p' || (k // 2) AS pkg, org, valid_from, valid_to FROM orgs WHERE k <> 7), shared AS (SELECT pkg, count(*) > 1 AS many FROM claims GROUP BY pkg),
r AS (SELECT o_orderkey AS id, 'p' || (o_custkey % 13) AS pkg, CAST(o_orderdate AS DATE) AS date FROM orders),
c AS (SELECT id, org, coalesce(date >= valid_from, TRUE) AND coalesce(date <= valid_to, TRUE) AS inside, many FROM r JOIN claims USING (pkg) JOIN shared USING (pkg))
SELECT org, NOT inside AS out_of_window, count(*) AS n FROM c WHERE NOT many OR inside GROUP BY ALL"""
)
def org_claims(spark, sf):
    """Resources to the organisations that claim their package at their date; one pair is disowned."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("p"), F.floor(F.col("n_nationkey") / 2).cast("string")).alias("pkg"), F.col("n_name").alias("org"), "n_nationkey")
    claims = n.join(orgs_of(spark, sf).select("org", "valid_from", "valid_to"), "org")
    o = table(spark, sf, "orders")
    resources = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), (F.col("o_custkey") % 13).cast("string")).alias("pkg"), F.col("o_orderdate").cast("date").alias("date"))
    out = corpus.claimed(resources, claims.drop("n_nationkey"), claims.where("n_nationkey = 7"))
    return out.groupBy("org", "out_of_window").agg(F.count("*").alias("n"))


_CAPTURES = """c AS (SELECT o_custkey AS file, strftime(o_orderdate, '%Y%m%d%H%M%S') || CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE '' END AS timestamp, CASE o_orderkey % 5 WHEN 0 THEN '404' WHEN 1 THEN '302' ELSE '200' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'text/html' ELSE 'text/csv' END AS mime, o_orderdate AS day FROM orders)"""


def _captures(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("file"),
        F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.when(k % 17 == 0, "x").otherwise("")).alias("timestamp"),
        F.when(k % 5 == 0, "404").when(k % 5 == 1, "302").otherwise("200").alias("status"),
        F.when(k % 3 == 0, "text/html").otherwise("text/csv").alias("mime"),
    )


_GOOD = "status = '200' AND mime <> 'text/html' AND timestamp NOT LIKE '%x'"


@query(
    f"""WITH {_CAPTURES}, g AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY abs(epoch(day) - epoch(TIMESTAMP '1998-03-31')), timestamp) AS place FROM c WHERE {_GOOD})
SELECT file, (SELECT min(timestamp) FROM c WHERE c.file = g.file AND {_GOOD}) AS earliest, timestamp AS nearest, mime FROM g WHERE place = 1"""
)
def archive_captures(spark, sf):
    """The earliest usable capture of each file, and the one nearest to a date."""
    captures = _captures(spark, sf)
    first = corpus.pick_capture(captures, "file").select("file", F.col("timestamp").alias("earliest"))
    return first.join(corpus.pick_capture(captures, "file", F.lit("19980331")).withColumnRenamed("timestamp", "nearest"), "file")


@query(f"WITH {_CAPTURES} SELECT file, min(timestamp) AS timestamp, '302' AS status FROM c WHERE status = '302' AND timestamp NOT LIKE '%x' GROUP BY file")
def archive_redirects(spark, sf):
    return corpus.pick_redirect(_captures(spark, sf), "file")


@query(
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'brand#1') AND contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'blue') AND p_size % 2 = 0
ORDER BY p_name, p_partkey LIMIT 10 OFFSET 10"""
)
def earner_roll_page(spark, sf):
    """The second page of a searched roll."""
    rows = table(spark, sf, "part").withColumn("civil", F.col("p_size") % 2 == 0)
    found = corpus.roll(rows, ["Brand#1", "blue"], over=["p_name", "p_type", "p_brand"], civil_only=True)
    return corpus.page(found, [F.col("p_name"), F.col("p_partkey")], 10, 1).select("p_partkey", "p_name")
