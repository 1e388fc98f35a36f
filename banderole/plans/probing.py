"""Two runs of the probe over the orders table as a list of lost files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import probe
from ..store import once
from .stand_in import query, table

SCOPE = {"2-HIGH": "not a file of posts"}


def _files(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("k"), F.concat(F.lit("u"), k.cast("string")).alias("url"), F.concat(F.lit("o"), (k % 40).cast("string")).alias("org"), F.col("o_orderdate").cast("date").cast("string").alias("date"), F.col("o_orderpriority").alias("reason"))


def _judged(spark, sf, items: DataFrame, changed: bool) -> DataFrame:
    """Verdicts of items; ``changed``: every tenth file that no capture was known of has one by now."""
    f, k = _files(spark, sf), F.col("k")
    seen = (k % 5 != 0) | (F.lit(changed) & (k % 10 == 0))
    resolved = f.select("url", F.when(seen, F.concat("url", F.lit("/x"))).alias("origin"), F.when(seen, "2019").alias("timestamp"), F.when(~seen, "no-capture").alias("reason"))
    bodies = f.where(seen).select("url", (k % 7 != 0).alias("ok"), F.when(k % 7 == 0, "archived-body-is-binary").alias("reason"), F.when(k % 7 == 0, "pdf").alias("detail"), F.sha2("url", 256).alias("sha256"))
    parsed = f.where(seen & (k % 7 != 0) & (k % 13 != 0)).select("url", (k % 3 == 0).alias("ok"), F.when(k % 3 == 1, "no-pay-columns").when(k % 3 == 2, "empty").alias("reason"), F.when(k % 11 == 0, 1).otherwise(9).alias("rows"), F.lit(60).alias("columns"))
    out = probe.verdicts(items, resolved, bodies, parsed, out_of_scope=SCOPE)
    return out.join(items.select("url", "fingerprint"), "url")


def _items(spark, sf, changed: bool) -> DataFrame:
    """The work list with what its verdicts rest on: ``captures`` of each file as they are known to that run."""
    k = F.col("k")
    return _files(spark, sf).select("url", "org", "date", "reason", F.when((k % 5 != 0) | (F.lit(changed) & (k % 10 == 0)), 1).otherwise(0).alias("captures"))


def _state(spark, sf, runs: int) -> DataFrame:
    state = spark.createDataFrame([], probe.STATE)
    for run in range(1, runs + 1):
        todo = once(probe.pending(_items(spark, sf, run > 1), state, ["reason", "captures"]))
        state = once(probe.merged(state, _judged(spark, sf, todo, run > 1), run))
    return state


_PROBED = """f AS (SELECT o_orderkey AS k, 'u' || o_orderkey AS url, o_orderpriority = '2-HIGH' AS scoped FROM orders),
v AS (SELECT *, k % 5 <> 0 OR k % 10 = 0 AS seen, k % 10 = 0 AS later FROM f),
s AS (SELECT url, k, CASE WHEN scoped THEN 'out-of-scope' WHEN NOT seen THEN 'no-capture' WHEN k % 7 = 0 THEN 'archived-body-is-binary' WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN 'lone-cr-not-normalised' WHEN k % 3 = 0 THEN 'ok' WHEN k % 3 = 1 THEN 'no-pay-columns' ELSE 'empty' END AS status,
  CASE WHEN scoped THEN 'not a file of posts' WHEN NOT seen THEN NULL WHEN k % 7 = 0 THEN 'pdf' WHEN k % 13 <> 0 AND k % 11 = 0 THEN '1 row x 60 columns' END AS detail, CAST(CASE WHEN later THEN 2 ELSE 1 END AS BIGINT) AS run FROM v)"""


@query(f"WITH {_PROBED} SELECT url, status, detail, run FROM s WHERE status IS NOT NULL UNION ALL SELECT url, 'no-capture', NULL, 1 FROM v WHERE k % 13 = 0 AND k % 7 <> 0 AND later AND NOT scoped")
def probe_state(spark, sf):
    """The state after two runs: the second probes only what has a capture by now."""
    return _state(spark, sf, 2).select("url", "status", "detail", "run")


@query("SELECT 'u' || o_orderkey AS url FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 7 <> 0 AND (o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0) AND o_orderpriority <> '2-HIGH'")
def probe_third_run(spark, sf):
    """What a third run over the same inputs would probe: files without a verdict, and nothing that has one."""
    return probe.pending(_items(spark, sf, True), _state(spark, sf, 2), ["reason", "captures"]).select("url")


@query(f"""WITH {_PROBED}, r AS (SELECT CASE WHEN status = 'ok' THEN 'verbatim' ELSE status END AS outcome, status = 'ok' AS recovered FROM s WHERE status IS NOT NULL UNION ALL SELECT 'no-capture', FALSE FROM v WHERE k % 13 = 0 AND k % 7 <> 0 AND later AND NOT scoped)
SELECT outcome, recovered, count(*) AS files FROM r GROUP BY ALL""")
def probe_reports(spark, sf):
    none = spark.createDataFrame([], "url string, pay string, rate double, status string")
    found, lost = probe.reports(_state(spark, sf, 2), none)
    both = found.select(F.col("kind").alias("outcome"), F.lit(True).alias("recovered")).unionByName(lost.select(F.col("reason").alias("outcome"), F.lit(False).alias("recovered")))
    return both.groupBy("outcome", "recovered").agg(F.count("*").alias("files"))


@query("""WITH RECURSIVE f AS (SELECT o_orderkey AS k, o_custkey AS org FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY org ORDER BY k) AS turn FROM f),
offers AS (SELECT t.k, t.org, t.turn, p.o_orderkey AS pay, (p.o_orderkey * 7 + t.k * 3) % 100 / 100.0 AS rate FROM t JOIN orders p ON p.o_custkey = t.org AND p.o_orderkey % 2 = 1),
steps AS (SELECT DISTINCT org, CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS pay, CAST(NULL AS DOUBLE) AS rate FROM f UNION ALL
  SELECT s.org, t.turn, CASE WHEN b.rate >= 0.5 THEN list_append(s.used, b.pay) ELSE s.used END, t.k, b.pay, b.rate FROM steps s JOIN t ON t.org = s.org AND t.turn = s.turn + 1
  LEFT JOIN LATERAL (SELECT arg_min(o.pay, {'r': -o.rate, 'p': 'p' || o.pay}) AS pay, CAST(max(o.rate) AS DOUBLE) AS rate FROM offers o WHERE o.org = s.org AND o.turn = t.turn AND NOT list_contains(s.used, o.pay)) b ON TRUE)
SELECT 'f' || k AS url, 'p' || pay AS pay, rate, CASE WHEN rate IS NULL THEN 'no-pay-file-found' WHEN rate < 0.5 THEN 'pay-join-too-sparse' ELSE 'joined' END AS status FROM steps WHERE turn > 0""")
def probe_halves(spark, sf):
    """Even orders of a customer choose among the odd ones, in their order."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("org"))
    posts, pays = o.where("k % 2 = 0"), o.where("k % 2 = 1").select(F.col("k").alias("pk"), "org")
    rates = posts.join(pays, "org").select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("url"), F.concat(F.lit("p"), F.col("pk").cast("string")).alias("pay"), ((F.col("pk") * 7 + F.col("k") * 3) % 100 / 100.0).alias("rate"))
    return probe.halves(posts.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("url"), "org", F.lit("2010").alias("date"), F.col("k").alias("place")), rates)
