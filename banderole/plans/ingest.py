"""Ingest queries: files written from the driver's orders, read by the CSV readers, against SQL on the orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import high_earners, posts_csv
from .stand_in import query, spread, table


def _orders(spark, sf) -> DataFrame:
    o, cust, n = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    joined = o.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    edge = (F.floor(F.col("o_totalprice") / 5000) * 5000).cast("long")
    return joined.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("ref"), F.col("n_name").alias("org"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("title"), edge.alias("lo"), (edge + 4999).alias("hi"))


def _pick(by: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values)).cast("int") + 1)


def _line(*columns: Column) -> Column:
    return F.concat_ws(",", *(F.concat(F.lit('"'), x.cast("string"), F.lit('"')) for x in columns))


def _files(rows: DataFrame, head: Column) -> DataFrame:
    """(path, content): a file for each organisation and year, as publishers cut them."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\r\n")
    made = spread(rows.select("org", "year", "k", "line"), "org", "year").groupBy("org", "year").agg(F.concat(F.max(head), F.lit("\r\n"), body).alias("text"))
    return made.select(F.concat_ws("/", "year", "org").alias("path"), F.encode("text", "UTF-8").alias("content"))


_SOURCE = """o AS (SELECT o_orderkey AS k, o_custkey, n_name AS org, year(o_orderdate) AS year, o_orderpriority AS title, CAST(floor(o_totalprice / 5000) * 5000 AS BIGINT) AS lo, CAST(floor(o_totalprice / 5000) * 5000 + 4999 AS BIGINT) AS hi
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


# --- senior posts ---------------------------------------------------------------------------------
POST_HEAD = "Post Unique Reference,Name,Grade (or equivalent),Job Title,FTE,Actual Pay Floor (£),Actual Pay Ceiling (£),Professional/Occupational Group,Valid?"


def post_files(spark, sf) -> DataFrame:
    k, o = F.col("k"), _orders(spark, sf)
    pounds = lambda x: F.when(k % 3 == 0, "N/A").otherwise(F.concat(F.lit("£"), F.format_number(x, 0)))
    line = _line(
        F.when(k % 13 == 0, "XX").otherwise(F.col("ref")),
        _pick(k, "Ash  Birch", "Vacant", "Eliminated", "N/D", "", "Redacted"),
        _pick(k, "SCS1", "Director", "SCS Band 3", "Grade 7", "Deputy Director"),
        _pick(k, "Head of Policy", "IT Director", "Solicitor", "Chief Nurse"),
        _pick(k, "1.00", "0.80", "N/A", "12"),
        pounds(F.col("lo")),
        pounds(F.col("hi")),
        _pick(k, "Finance", "", "Other"),
        F.when(k % 10 == 3, "0").otherwise("1"),
    )
    return _files(o.withColumn("line", F.when(k % 50 == 7, ",,,,,,,,1").otherwise(line)), F.lit(POST_HEAD))


_POSTS = f"""{_SOURCE},
p AS (SELECT org, year, k, CASE WHEN k % 13 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS pur,
  ['filled-named', 'vacant', 'eliminated', 'filled-undisclosed', 'blank', 'redacted'][k % 6 + 1] AS status,
  ['SCS1 (Dep Dir)', 'SCS2 (Dir)', 'SCS3 (Dir Gen)', 'Below SCS', 'SCS1 (Dep Dir)'][k % 5 + 1] AS grade,
  CASE WHEN k % 3 = 0 THEN 'Finance' ELSE ['Policy', 'Digital, Data & Technology', 'Legal', 'Medical & Health'][k % 4 + 1] END AS prof, CASE WHEN k % 3 = 0 THEN 'group' ELSE 'title' END AS prof_source,
  k % 4 = 1 AS ddat, k % 4 = 0 AS pol, CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 END AS fte, CASE WHEN k % 3 > 0 AND lo > 0 THEN lo END AS floor, CASE WHEN k % 3 > 0 THEN hi END AS ceil
  FROM o WHERE k % 50 <> 7 AND k % 10 <> 3),
q AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'N/A' WHEN ceil < 30000 OR coalesce(floor, ceil) > 800000 THEN 'implausible' END AS withheld_reason,
  CASE WHEN pur = '' THEN 0 ELSE row_number() OVER (PARTITION BY org, year, pur ORDER BY k) - 1 END AS ordinal FROM p)"""


@query(
    f"""WITH {_POSTS} SELECT org, year, status, grade, prof, prof_source, ddat, pol, withheld_reason, count(*) AS n, CAST(sum(ordinal) AS BIGINT) AS ordinals, CAST(count(*) FILTER (WHERE pur = '') AS BIGINT) AS nameless,
  CAST(sum(fte) AS DOUBLE) AS fte, CAST(sum(floor) AS DOUBLE) AS floors, CAST(sum(ceil) AS DOUBLE) AS ceils,
  CAST(sum(CASE WHEN withheld_reason IS NOT NULL THEN -1 WHEN floor IS NULL THEN -2 ELSE floor // 5000 END) AS BIGINT) AS bins FROM q GROUP BY ALL"""
)
def ingest_posts(spark, sf):
    """Post files to typed rows: flags, blank rows, repeats, classification, bands."""
    posts, _ = posts_csv.normalise(posts_csv.raw_rows(post_files(spark, sf)))
    rows = posts.select(F.split("file", "/")[1].alias("org"), F.split("file", "/")[0].cast("int").alias("year"), "*")
    return rows.groupBy("org", "year", "status", "grade", "prof", "prof_source", "ddat", "pol", "withheld_reason").agg(
        F.count("*").alias("n"), F.sum("ordinal").alias("ordinals"), F.count_if(F.col("pur") == "").alias("nameless"), F.round(F.sum("fte"), 6).alias("fte"), F.sum("floor").alias("floors"), F.sum("ceil").alias("ceils"), F.sum("bin_low").alias("bins")
    )


@query(
    f"""WITH {_SOURCE} SELECT org, year, CAST(NULL AS VARCHAR) AS reason, count(*) AS data_rows, CAST(count(*) FILTER (WHERE k % 50 = 7) AS BIGINT) AS blank_rows, CAST(count(*) FILTER (WHERE k % 50 <> 7) AS BIGINT) AS kept_rows,
  CAST(count(*) FILTER (WHERE k % 50 <> 7 AND k % 3 > 0 AND k % 10 <> 3) AS BIGINT) AS pay_valid, CAST(count(*) FILTER (WHERE k % 50 <> 7 AND k % 3 > 0 AND k % 10 = 3) AS BIGINT) AS pay_invalid FROM o GROUP BY ALL"""
)
def ingest_post_files(spark, sf):
    """What each post file held, and that none was refused."""
    _, files = posts_csv.normalise(posts_csv.raw_rows(post_files(spark, sf)))
    return files.select(F.split("file", "/")[1].alias("org"), F.split("file", "/")[0].cast("int").alias("year"), "reason", "data_rows", "blank_rows", "kept_rows", "pay_valid", "pay_invalid")


# --- high earners ---------------------------------------------------------------------------------
HEADS = {
    "A": "Name,Job Title,Grade,Organisation,Annual pay rate - including taxable benefits,Notes",
    "B": "Post Unique Reference,Surname,Forename(s),Grade Equivalent,Job Title,Parent Department,Organisation,Type of organisation,Total Pay Floor (£),Total Pay Ceiling (£)",
    "C": "Surname,Forename(s),Grade Equivalent,Job Title,Parent Department,Organisation,Type of organisation,Total pay floor and ceiling range (£),Notes",
}


def earner_files(spark, sf) -> DataFrame:
    k, o = F.col("k"), _orders(spark, sf)
    lo, hi, none = F.col("lo").cast("string"), F.col("hi").cast("string"), F.lit("")
    grade = _pick(k, "Director", "Non-Executive Director", "VSM", "Lieutenant General", "Deputy Director", "SCS3")
    kind = _pick(k, "civil service", "Other central government", "", "Quango")
    surname, forename = _pick(k, "Elm", "Vacant", ""), _pick(k, "Jo", "", "")
    money = lambda x: F.concat(F.lit("£"), F.format_number(x, 0))
    combined = F.when(k % 5 == 1, none).when(k % 5 == 0, "£40k").otherwise(F.concat(money(F.col("lo")), F.lit(" - "), money(F.col("hi"))))
    floor = F.when(k % 5 == 1, none).when(k % 5 == 2, hi).otherwise(lo)
    ceil = F.when(k % 5 < 2, none).when(k % 5 == 2, lo).otherwise(hi)
    org, title, parent = F.col("org"), F.col("title"), F.lit("Parent")
    a = _line(F.trim(F.concat_ws("  ", forename, surname)), title, grade, org, combined, none)
    b = _line(F.col("ref"), surname, forename, grade, title, parent, org, kind, floor, ceil)
    c = _line(surname, forename, grade, title, parent, org, kind, F.when(k % 5 == 1, none).otherwise(F.concat(lo, F.lit(" - "), hi)), none)
    early, late = F.col("year") < 1997, F.col("year") > 1999
    head = F.when(early, HEADS["A"]).when(late, HEADS["C"]).otherwise(HEADS["B"])
    return _files(o.withColumn("line", F.when(early, a).when(late, c).otherwise(b)), head)


_EARNERS = f"""{_SOURCE},
s AS (SELECT *, CASE WHEN year < 1997 THEN 'A' WHEN year > 1999 THEN 'C' ELSE 'B' END AS parser FROM o),
m AS (SELECT *, CASE WHEN k % 5 = 1 THEN NULL WHEN parser = 'A' AND k % 5 = 0 THEN 40000 WHEN parser = 'B' AND k % 5 = 2 THEN hi WHEN lo > 0 THEN lo END AS x,
  CASE WHEN k % 5 = 1 OR parser = 'B' AND k % 5 = 0 THEN NULL WHEN parser = 'A' AND k % 5 = 0 THEN 40000 WHEN parser = 'B' AND k % 5 = 2 THEN CASE WHEN lo > 0 THEN lo END ELSE hi END AS y FROM s),
e AS (SELECT org, year, parser, ['SCS2 (Dir)', 'Non-executive / chair', 'NHS very senior manager', 'Military (OF-6+)', 'SCS1 (Dep Dir)', 'SCS3 (Dir Gen)'][k % 6 + 1] AS band, CASE WHEN k % 6 = 3 THEN 'OF-8' END AS variant,
  CASE WHEN parser = 'A' THEN NULL ELSE ['Civil Service', 'Other central government', NULL, 'Quango'][k % 4 + 1] END AS org_type,
  CASE WHEN x IS NULL AND y IS NULL THEN 'not-published' WHEN y IS NULL THEN 'floor-only' WHEN x IS NULL OR x = y THEN 'exact' ELSE 'band' END AS pay_kind,
  CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE least(x, y) END AS floor, CASE WHEN y IS NOT NULL THEN greatest(coalesce(x, y), y) END AS ceil, CASE WHEN k % 3 = 0 THEN 'Jo Elm' END AS holder FROM m)"""


@query(f"""WITH {_EARNERS} SELECT year, parser, band, variant, org_type, pay_kind, holder, count(*) AS n, CAST(sum(floor) AS BIGINT) AS floors, CAST(sum(ceil) AS BIGINT) AS ceils FROM e GROUP BY ALL""")
def ingest_high_earners(spark, sf):
    """Lists of three header shapes to one row shape: grades, names, pay kinds, types."""
    rows = high_earners.listed(high_earners.raw_rows(earner_files(spark, sf))).withColumn("year", F.split("file", "/")[0].cast("int"))
    return rows.groupBy("year", "parser", "band", "variant", "org_type", "pay_kind", "holder").agg(F.count("*").alias("n"), F.sum("floor").alias("floors"), F.sum("ceil").alias("ceils"))


@query(
    f"""WITH {_EARNERS} SELECT org, year, parser, CAST(NULL AS VARCHAR) AS reason, count(*) AS data_rows, CAST(0 AS BIGINT) AS blank_rows, CAST(count(*) FILTER (WHERE pay_kind = 'not-published') AS BIGINT) AS not_published,
  CAST(count(*) FILTER (WHERE org_type = 'Civil Service') AS BIGINT) AS civil_service, coalesce(max(org_type) FILTER (WHERE org_type = 'Quango'), '') AS unknown_types FROM e GROUP BY org, year, parser"""
)
def ingest_high_earner_files(spark, sf):
    """Per list: shape, rows, unpublished pay, civil service rows, types that aren't on the list."""
    files = high_earners.file_stats(high_earners.raw_rows(earner_files(spark, sf)))
    return files.select(
        F.split("file", "/")[1].alias("org"), F.split("file", "/")[0].cast("int").alias("year"), "parser", "reason", "data_rows", "blank_rows", "not_published", "civil_service", F.array_join("unknown_types", "|").alias("unknown_types")
    )
