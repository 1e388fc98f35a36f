"""Published tables made of suppliers, parts and orders: statistics, regions, resources, tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fmt
from ..operators import benchmarks
from .stand_in import query, table


@query("""WITH c AS (SELECT p_partkey AS k, p_partkey % 6 AS kind, CAST(floor(p_retailprice * 10) AS BIGINT) AS v, p_size AS s FROM part),
n AS (SELECT *, CASE WHEN kind <> 1 THEN floor(s * 10 / 1000.0 * 10 + 0.5) / 10 END AS jobs, CASE WHEN kind <> 2 THEN v::DOUBLE END AS median, CASE WHEN kind <> 3 THEN (v + 100)::DOUBLE END AS p75 FROM c),
g AS (SELECT *, coalesce(jobs * 1000 < 30 AND median IS NOT NULL, FALSE) AS below FROM n)
SELECT k, jobs::DOUBLE AS jobs, CASE WHEN NOT below THEN median END AS median, CASE WHEN NOT below THEN p75 END AS p75, jobs IS NOT NULL AS n_known,
  concat_ws(';', CASE WHEN kind = 1 THEN 'jobs=unreliable' END, CASE WHEN kind = 2 THEN 'median=disclosive' END, CASE WHEN below THEN 'n_floor=below-30' END, CASE WHEN kind = 3 THEN 'p75=blank' END) AS suppressed FROM g""")
def published_stats(spark, sf):
    """A row of cells for every part: job counts in thousands, some suppressed, some too few."""
    k, v = F.col("p_partkey"), F.floor(F.col("p_retailprice") * 10)
    kind = k % 6
    cells = {
        "jobs": F.when(kind == 1, "x").otherwise((F.col("p_size") * 10 / 1000).cast("string")), "median": F.when(kind == 2, "..").otherwise(F.format_number(v, 0)), "p75": F.when(kind == 3, "").otherwise((v + 100).cast("string")),
    }
    out = table(spark, sf, "part").select(k.alias("k"), benchmarks.stats(cells).alias("s"))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("s.suppressed")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("k", "s.jobs", "s.median", "s.p75", "s.n_known", said.alias("suppressed"))


@query("""WITH f AS (SELECT s_nationkey, arg_min(s_acctbal, s_suppkey) AS v, min(s_suppkey) AS k FROM supplier GROUP BY 1)
SELECT CAST(s_nationkey AS VARCHAR) AS code, k, CAST(v AS DOUBLE) AS balance, coalesce(r_name, '—') AS region FROM f JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 4""")
def published_rows_by_code(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("code"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").cast("double").alias("balance"))
    first = benchmarks.row_by_code(s, "code", "k")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_regionkey").alias("region_idx"))
    regions = table(spark, sf, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("region_idx"), F.col("r_name").alias("region"))
    return benchmarks.region_rows(first.join(nations, "code"), regions).select("code", "k", "balance", "region")


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 7 AS kind, o_orderkey % 3 AS form FROM orders)
SELECT k, form <> 2 AS csv, kind IN (0, 1, 4) AS senior FROM r""")
def senior_resources(spark, sf):
    k = F.col("o_orderkey")
    kind, form = k % 7, k % 3
    stem = F.when(kind == 0, "Senior-posts").when(kind == 1, "a%53enior").when(kind == 2, "junior-senior").when(kind == 3, "%4Aunior").otherwise("posts")
    url = F.concat(F.lit("https://x/"), stem, F.when(form == 0, ".CSV?v=1").when(form == 1, "").otherwise(".csv.zip"))
    name = F.when(kind == 4, "SENIOR staff").when(kind == 5, "Senior and junior").otherwise(F.lit(None))
    return table(spark, sf, "orders").select(k.alias("k"), benchmarks.is_csv(url, F.when(form == 1, "csv")).alias("csv"), benchmarks.looks_senior(url, name).alias("senior"))


@query("""WITH y AS (SELECT year(CAST(o_orderdate AS DATE)) AS year, count(*) AS n FROM orders GROUP BY 1)
SELECT 'long' AS kind, CAST(year AS INTEGER) AS year, CAST(n AS DOUBLE) AS "index", TRUE AS live FROM y UNION ALL SELECT 'short', CAST(year AS INTEGER), 100.0, FALSE FROM y""")
def index_or_stand_in(spark, sf):
    """Orders a year as a fetched index, and its first three years, too few to be one."""
    years = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("index"))
    hundred = years.withColumn("index", F.lit(100.0))
    long, short = benchmarks.index_or(years, hundred), benchmarks.index_or(years.where("year < 1998"), hundred)
    return long.select(F.lit("long").alias("kind"), "year", "index", "live").unionByName(short.select(F.lit("short").alias("kind"), "year", "index", "live"))


@query("""WITH c AS (SELECT o_orderstatus AS status, coalesce(o_orderpriority, '') AS grade, count(*) AS n FROM orders GROUP BY ALL) SELECT status, string_agg(grade || '=' || n, ';' ORDER BY grade) AS counts FROM c GROUP BY status""")
def grade_tally(spark, sf):
    t = benchmarks.tally(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), "status", key="o_orderpriority")
    return t.select("status", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("counts"))


@query("""WITH m AS (SELECT *, (['headcount', 'disclosureRate', 'paybill', 'meanPay', 'medianPay', 'odd'])[c_custkey % 6 + 1] AS measure, floor(abs(c_acctbal)) * 100 AS v FROM customer)
SELECT c_custkey AS k, (['Senior posts', 'Disclosure rate', 'Senior pay bill', 'Mean pay', 'Median pay band', 'odd'])[c_custkey % 6 + 1] AS label,
  (['published senior posts', 'share of published senior posts', '£ per year, base pay, FTE-weighted', '£ per year, base pay', '£ per year, base pay', '£ per year, base pay'])[c_custkey % 6 + 1] AS unit,
  CASE c_custkey % 6 WHEN 0 THEN format('{:,}', CAST(v AS BIGINT)) WHEN 3 THEN '£' || format('{:,}', CAST(floor(v / 1000 + 0.5) * 1000 AS BIGINT)) WHEN 4 THEN '£' || format('{:,}', CAST(v AS BIGINT)) WHEN 5 THEN '£' || format('{:,}', CAST(v AS BIGINT)) END AS shown
FROM m WHERE c_custkey % 6 NOT IN (1, 2) UNION ALL SELECT c_custkey, (['Disclosure rate', 'Senior pay bill'])[c_custkey % 6], (['share of published senior posts', '£ per year, base pay, FTE-weighted'])[c_custkey % 6], NULL FROM customer WHERE c_custkey % 6 IN (1, 2)""")
def measure_texts(spark, sf):
    """Measures as they print; shares and bills, whose rounding differs between engines, with their labels alone."""
    k = F.col("c_custkey")
    m = F.get(F.array(*map(F.lit, ("headcount", "disclosureRate", "paybill", "meanPay", "medianPay", "odd"))), (k % 6).cast("int"))
    shown = F.when(~(k % 6).isin(1, 2), fmt.measure_text(m, F.floor(F.abs("c_acctbal")).cast("double") * 100))
    return table(spark, sf, "customer").select(k.alias("k"), fmt.measure_label(m).alias("label"), fmt.measure_unit(m).alias("unit"), shown.alias("shown"))
