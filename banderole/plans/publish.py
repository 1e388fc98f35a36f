"""Releases of the orders table, their history and the documents of two owners."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks import owned
from ..sinks.releases import Refused, Releases
from ..store import shared_dir
from .stand_in import query, table

CUTS = (1997, 1999, 1999, 2001)


def _releases(spark, sf) -> Releases:
    """Orders before 1997, 1999, 1999 again (nothing new) and 2001; between them a release that fails and one that is refused."""
    out = Releases(spark, f"{shared_dir(spark)}/releases-{uuid.uuid4().hex}")
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.trunc("o_orderdate", "month").cast("date").alias("month"), "o_orderstatus")
    for cut in CUTS:
        upto = orders.where(F.col("year") < cut)
        months = upto.groupBy("month").agg(F.count("*").alias("n"))
        try:
            out.publish({"posts": upto, "months": months.where("false")})
        except Refused:
            pass
        out.publish({"posts": upto, "months": months}, stats={"cut": cut})
    return out


_HISTORY = "cuts AS (SELECT * FROM (VALUES (1, 1997), (2, 1999), (3, 2001)) AS t(version, cut)), o AS (SELECT o_orderkey, year(CAST(o_orderdate AS DATE)) AS year, date_trunc('month', CAST(o_orderdate AS DATE)) AS month FROM orders)"


@query(f"""WITH {_HISTORY}, n AS (SELECT CAST(version AS BIGINT) AS version, CAST(cut AS VARCHAR) AS cut, count(*) AS posts, count(DISTINCT month) AS months FROM cuts JOIN o ON year < cut GROUP BY ALL),
e AS (SELECT version, cut, 'posts' AS "name", posts AS rows FROM n UNION ALL SELECT version, cut, 'months', months FROM n)
SELECT version, cut, "name", lag(rows) OVER (PARTITION BY name ORDER BY version) AS rows_before, rows, TRUE AS changed FROM e""")
def release_history(spark, sf):
    r = _releases(spark, sf)
    return r.history().withColumnRenamed("table", "name").join(r.manifests().select("version", F.col("stats")["cut"].alias("cut")), "version").select("version", "cut", "name", "rows_before", "rows", "changed")


@query(f"WITH {_HISTORY} SELECT DISTINCT CAST(month AS DATE) AS month FROM o WHERE year BETWEEN 1999 AND 2000")
def release_dates_added(spark, sf):
    return _releases(spark, sf).added("posts", "month")


def _store(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Bodies of every second order, a third of them of the archive (some changed since, some broken), and what the archive offers."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    body = F.when(k % 7 == 0, F.lit("broken")).otherwise(F.concat(F.lit("file "), k.cast("string")))
    owner = F.when(k % 3 == 0, "archive").otherwise("ingest")
    old = o.where(k % 2 == 0).select(k.cast("string").alias("key"), body.alias("body"), owner.alias("owner"), F.sha2(F.when(k % 5 == 0, F.lit("other")).otherwise(body).cast("binary"), 256).alias("sha256"))
    return old, o.where(k % 4 <= 1).select(k.cast("string").alias("key"), F.concat(F.lit("copy "), k.cast("string")).alias("body"))


_STORE = """s AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'broken' ELSE 'file ' || o_orderkey END AS body, CASE WHEN o_orderkey % 3 = 0 THEN 'archive' ELSE 'ingest' END AS owner, o_orderkey % 2 = 0 AS old, o_orderkey % 4 <= 1 AS offered FROM orders),
o AS (SELECT *, CASE WHEN NOT old AND offered THEN 'added' WHEN NOT offered THEN 'kept' WHEN owner = 'archive' AND k % 5 <> 0 THEN 'replaced' WHEN k % 7 <> 0 THEN 'refused' ELSE 'replaced' END AS outcome FROM s WHERE old OR offered)"""


@query(f"WITH {_STORE} SELECT key, outcome FROM o")
def emit_outcomes(spark, sf):
    old, new = _store(spark, sf)
    return owned.merged(old, new, "archive", F.col("body").startswith("file")).select("key", "outcome")


@query(f"""WITH {_STORE}, a AS (SELECT key, k, CASE WHEN outcome IN ('added', 'replaced') THEN 'copy ' || k ELSE body END AS body, CASE WHEN outcome IN ('added', 'replaced') THEN 'archive' ELSE owner END AS owner FROM o)
SELECT key, body, owner FROM a WHERE NOT (k % 8 = 0 AND owner = 'archive')""")
def emit_then_withdraw(spark, sf):
    old, new = _store(spark, sf)
    after = owned.emit(old, new, "archive", F.col("body").startswith("file"))
    gone = table(spark, sf, "orders").where("o_orderkey % 8 = 0").select(F.col("o_orderkey").cast("string").alias("key"))
    return owned.withdraw(after, gone, "archive").select("key", "body", "owner")
