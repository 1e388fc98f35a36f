"""Blocks of documents, tables of medians, correction notices, picks of editions, and gates over two builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality, sections
from .stand_in import query, table

HEADING, END, MOST = "[0-9]", r"^\s*$|\.$", 4


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN regexp_matches(line, '{HEADING}') THEN 'heading' WHEN regexp_matches(line, '{END}') THEN 'terminator' END AS kind, max(i) OVER (PARTITION BY doc_id) + 1 AS n FROM l),
s AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS stop, lead(kind) OVER (PARTITION BY doc_id ORDER BY i) AS stop_kind FROM k WHERE kind IS NOT NULL)
SELECT doc_id, CAST(i AS INTEGER) AS start, CAST(least(coalesce(stop, n) - i, {MOST}) AS INTEGER) AS size, CASE WHEN coalesce(stop, n) - i > {MOST} THEN 'limit' ELSE coalesce(stop_kind, 'end') END AS how,
  md5((SELECT string_agg(k.line, chr(10) ORDER BY k.i) FROM k WHERE k.doc_id = s.doc_id AND k.i >= s.i AND k.i < s.i + least(coalesce(stop, s.n) - s.i, {MOST}))) AS body FROM s WHERE kind = 'heading'""")
def document_blocks(spark, sf):
    """Lines with digits open blocks; blank lines and lines that end in a full stop close them, four lines are the most."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return sections.blocks(docs, HEADING, end=END, most=MOST).select("doc_id", "start", F.size("lines").alias("size"), "how", F.md5(F.array_join("lines", "\n")).alias("body"))


def reports_of(spark, sf) -> DataFrame:
    """A report for every supplier, with a table of medians, a list of groups and a correction notice; every fourth table is cut short by a chapter."""
    k, v = F.col("s_suppkey"), F.floor(F.col("s_acctbal") + 2000).cast("long")
    pound = lambda i: F.when(k % 5 == i, "..").otherwise(F.concat(F.lit("£"), F.format_number(v + 1000 * i, 0)))
    row = lambda y: F.concat(F.lit(f"  {y}   "), F.concat_ws("    ", *(pound(i) for i in range(4))))
    text = F.concat_ws(
        "\n", F.lit("Table 2: other"), F.lit("2001 £1 £2 £3 £4"), F.lit("Table 3: SCS median salary by payband and year"), F.lit("        DD  1A  D  DG"), row(2019), F.when(k % 4 == 0, "Chapter 9"), row(2020), F.lit("20 20 note"), F.lit("Chapter 4"),
        F.lit("Region: North"), F.concat(F.lit("posts "), (k % 7).cast("string")), F.concat(F.lit("posts "), (k % 11).cast("string")), F.lit("Region: South"), F.concat(F.lit("posts "), (k % 13).cast("string")),
    )
    notice = F.concat(F.lit("Estimates for occupations "), (1000 + k % 9).cast("string"), F.lit(", 3312 and "), (2000 + k % 3).cast("string"), F.lit(" are suppressed in Tables 14, 15 and 20. Occupation 3312 again."))
    return table(spark, sf, "supplier").select(k.alias("k"), text.alias("text"), notice.alias("notice"))


@query("""WITH s AS (SELECT s_suppkey AS k, CAST(floor(s_acctbal + 2000) AS BIGINT) AS v, unnest([2019, 2020]) AS year FROM supplier)
SELECT k, CAST(year AS INTEGER) AS year, CASE WHEN k % 5 <> 0 THEN v END AS deputy_director, CASE WHEN k % 5 <> 1 THEN v + 1000 END AS deputy_director_1a, CASE WHEN k % 5 <> 2 THEN v + 2000 END AS director, CASE WHEN k % 5 <> 3 THEN v + 3000 END AS director_general
FROM s WHERE year = 2019 OR k % 4 <> 0""")
def evidence_medians(spark, sf):
    found = sections.blocks(reports_of(spark, sf).drop("notice"), r"^\s*Table 3: SCS median salary by payband and year", end="^Chapter", most=40)
    return found.select("k", F.inline(sections.median_rows(F.col("lines"))))


@query("""SELECT s_suppkey AS k, unnest(['North', 'North', 'South']) AS label, unnest([CAST(s_suppkey % 7 AS VARCHAR), CAST(s_suppkey % 11 AS VARCHAR), CAST(s_suppkey % 13 AS VARCHAR)]) AS value FROM supplier""")
def labelled_values(spark, sf):
    found = sections.blocks(reports_of(spark, sf).drop("notice"), "^Chapter 4")
    return found.select("k", F.inline(sections.carried(F.col("lines"), "^Region: (.*)$", "^posts ([0-9]+)$")))


@query("SELECT s_suppkey AS k, CAST(1000 + s_suppkey % 9 AS VARCHAR) || ',' || CAST(2000 + s_suppkey % 3 AS VARCHAR) || ',3312' AS codes FROM supplier")
def correction_notice_codes(spark, sf):
    return reports_of(spark, sf).select("k", F.array_join(sections.correction_codes(F.col("notice")), ",").alias("codes"))


def _editions(spark, sf) -> DataFrame:
    """Orders as published documents of a customer and year: reports, supplements, letters, and reports under their plain name."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    name = F.when(k % 6 == 0, F.concat(F.lit("/pay-review-report-"), year.cast("string"))).when(k % 6 == 1, "/Report-Supplement").when(k % 6 == 2, "/remit-letter").when(k % 6 == 3, "/a-report").otherwise("/press")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("body"), year.alias("year"), F.concat(F.lit("/b/"), k.cast("string"), name).alias("path"), F.col("o_orderdate").cast("date").cast("string").alias("ts"), k.alias("k"))


@query("""WITH e AS (SELECT o_custkey AS body, year(CAST(o_orderdate AS DATE)) AS year, o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS ts, CASE o_orderkey % 6 WHEN 0 THEN 50 WHEN 1 THEN -90 WHEN 2 THEN -100 WHEN 3 THEN 10 ELSE 0 END AS score FROM orders)
SELECT body, CAST(year AS INTEGER) AS year, CAST(arg_max(k, {'s': score, 't': ts, 'k': k}) AS BIGINT) AS k, CAST(max(score) AS INTEGER) AS score FROM e GROUP BY ALL""")
def edition_picks(spark, sf):
    e = _editions(spark, sf)
    return sections.best(e, ["body", "year"], sections.edition_score(F.col("path"), F.col("year"), "pay-review-report-"), F.col("ts"), F.col("k")).select("body", "year", "k", "score")


@query("""WITH a AS (SELECT o_custkey AS body, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 25 WHEN 1 THEN 10 WHEN 2 THEN -90 WHEN 3 THEN 2 ELSE 0 END + CAST(least(20, floor(o_totalprice * 100 / 512000 + 0.5)) AS INTEGER) AS score FROM orders)
SELECT body, CAST(arg_max(k, {'s': score, 'k': -k}) AS BIGINT) AS k, CAST(max(score) AS INTEGER) AS score FROM a GROUP BY body""")
def attachment_picks(spark, sf):
    k = F.col("o_orderkey")
    title = F.when(k % 5 == 0, "The 47th Report").when(k % 5 == 1, "Annual  report").when(k % 5 == 2, "Supplement to the report").when(k % 5 == 3, "Accessible version").otherwise(F.lit(None))
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("body"), k.alias("k"), title.alias("title"), F.lit("/file.pdf").alias("url"), (F.col("o_totalprice") * 100).alias("size"))
    return sections.best(a, ["body"], sections.attachment_score(F.col("title"), F.col("url"), F.col("size")), -F.col("k")).select("body", "k", "score")


# --- gates over two builds ------------------------------------------------------------------------
def _build(spark, sf, share: float, year: int) -> DataFrame:
    """What a build sums up to: orders before a year, of which a share of customers is read; statuses stand for failed and undated files."""
    o = table(spark, sf, "orders").where((F.year("o_orderdate") < year) & (F.col("o_custkey") % 100 < int(share * 100)))
    return o.agg(
        F.countDistinct("o_custkey").alias("snapshots"), F.count("*").alias("posts"), F.count_if(F.col("o_orderstatus") == "P").alias("failures"), F.count("*").alias("files"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("undated")
    )


_SUMS = """count(DISTINCT o_custkey) AS snapshots, count(*) AS posts, count(*) FILTER (WHERE o_orderstatus = 'P') AS failures, count(*) AS files, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS undated FROM orders"""


def _gates_sql(name: str, before: str, now: str) -> str:
    return f"""SELECT '{name}' AS build, gate, level FROM (SELECT unnest(['snapshots', 'posts', 'failures', 'failure-rate', 'undated']) AS gate, unnest([CASE WHEN n.snapshots < b.snapshots THEN 'fail' END,
  CASE WHEN n.posts / b.posts - 1 <= {quality.POSTS_FAIL} THEN 'fail' WHEN n.posts / b.posts - 1 <= {quality.POSTS_WARN} THEN 'warn' END, CASE WHEN n.failures - b.failures >= 5 THEN 'warn' END,
  CASE WHEN n.failures / n.files - b.failures / b.files >= 0.02 THEN 'fail' END, CASE WHEN n.undated - b.undated >= 10 THEN 'warn' END]) AS level
  FROM (SELECT {_SUMS} {before}) b, (SELECT {_SUMS} {now}) n) WHERE level IS NOT NULL"""


_OF = "WHERE year(CAST(o_orderdate AS DATE)) < {} AND o_custkey % 100 < {}"


@query(" UNION ALL ".join((_gates_sql("grown", _OF.format(1999, 100), _OF.format(2001, 100)), _gates_sql("shrunk", _OF.format(2001, 100), _OF.format(2001, 80)), _gates_sql("same", _OF.format(2001, 100), _OF.format(2001, 100)))))
def build_gates(spark, sf):
    """Gates between a build and one that grew, one that lost a fifth of its bodies, and itself."""
    whole, small = _build(spark, sf, 1.0, 2001), _build(spark, sf, 1.0, 1999)
    pairs = {"grown": (small, whole), "shrunk": (whole, _build(spark, sf, 0.8, 2001)), "same": (whole, whole)}
    parts = [quality.total_gates(b, n).select(F.lit(name).alias("build"), "gate", "level") for name, (b, n) in pairs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS pair FROM part WHERE p_partkey % 40 = 0),
t AS (SELECT s_suppkey AS k, (SELECT lower(p_name) FROM part WHERE p_partkey = s_suppkey) AS name FROM supplier)
SELECT k, pair FROM t JOIN n ON name = pair""")
def name_leaks(spark, sf):
    """Suppliers' notes that name one of some parts, whose names stand for people's."""
    parts = table(spark, sf, "part")
    notes = table(spark, sf, "supplier").join(parts, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("k"), F.concat(F.lit("Seen: "), F.initcap("p_name"), F.lit("!")).alias("note"))
    return quality.name_leaks(notes, parts.where("p_partkey % 40 = 0").select(F.col("p_name").alias("name")), "k", "note")
