"""The honesty audit over nested tables made of orders and their lines, with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import honesty
from .stand_in import query, table


def nested_of(spark, sf) -> DataFrame:
    """An order as a table of sections, a line each; sources stand at the top, at the section, or nowhere."""
    def section(line):
        n, q = line["n"], line["q"]
        deep = F.struct(F.when(n % 3 == 0, 0).alias("max"), F.create_map(F.lit("b"), F.struct(F.when(q % 5 == 0, q).alias("median"), F.when(q % 4 == 0, "s").alias("sourceUrl"))).alias("by"))
        rows = F.array(
            F.struct(F.when(q % 10 != 0, q).otherwise(0.0).alias("median"), F.lit(1.0).alias("p25"), F.lit(None).cast(deep_type()).alias("deep")),
            F.struct(F.lit(None).cast("double").alias("median"), F.when(q % 7 == 0, 0.0).otherwise(5.0).alias("p25"), deep.cast(deep_type()).alias("deep")),
        )
        return F.struct(n.alias("n"), F.when(n % 2 == 0, "s").alias("src"), rows.alias("rows"))

    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("q"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))  # an order's few lines
    return lines.select("l_orderkey", F.struct(F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey")).alias("id"), F.transform("lines", section).alias("sections")).alias("doc"))


def deep_type() -> str:
    return "struct<max:int,by:map<string,struct<median:double,sourceUrl:string>>>"


_PLACES = "l AS (SELECT l_orderkey, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS q, 'doc.sections[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1) || ']' AS place, l_orderkey % 4 = 0 OR l_linenumber % 2 = 0 AS sourced FROM lineitem)"


@query(f"""WITH {_PLACES} SELECT l_orderkey, place || '.rows[0].median' AS path, '{honesty.ZERO}' AS problem FROM l WHERE q % 10 = 0
UNION ALL SELECT l_orderkey, place || '.rows[1].p25', '{honesty.ZERO}' FROM l WHERE q % 7 = 0
UNION ALL SELECT l_orderkey, place || '.rows[1].deep.max', '{honesty.ZERO}' FROM l WHERE n % 3 = 0
UNION ALL SELECT l_orderkey, place || '.rows[0]', '{honesty.UNSOURCED}' FROM l WHERE NOT sourced
UNION ALL SELECT l_orderkey, place || '.rows[1].deep.by.b', '{honesty.UNSOURCED}' FROM l WHERE NOT sourced AND q % 5 = 0 AND q % 4 <> 0""")
def honesty_figures(spark, sf):
    return honesty.figures(nested_of(spark, sf), ["doc"], "l_orderkey")


@query("""WITH e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS d, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS verified, CASE WHEN o_orderkey % 3 = 0 THEN FALSE WHEN o_orderkey % 3 = 1 THEN TRUE END AS resolved,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'u' END AS url, CASE o_orderstatus WHEN 'F' THEN 'fact' WHEN 'O' THEN 'contested' ELSE 'sure' END AS confidence, o_orderkey % 11 <> 0 AS has_values FROM orders),
x AS (SELECT *, has_values AND coalesce(resolved, TRUE) AS shown FROM e)
SELECT id, 'never reviewed' AS problem FROM x WHERE d IS NULL
UNION ALL SELECT id, 'reviewed too long ago' FROM x WHERE d IS NOT NULL AND (DATE '1999-01-01' - d) / 30.44 > 14
UNION ALL SELECT id, 'no verified flag' FROM x WHERE d IS NOT NULL AND verified IS NULL
UNION ALL SELECT id, 'unverified values that aren''t marked' FROM x WHERE d IS NOT NULL AND shown AND NOT verified
UNION ALL SELECT id, 'values without a source that aren''t marked' FROM x WHERE d IS NOT NULL AND shown AND url IS NULL
UNION ALL SELECT id, 'confidence of no known kind' FROM x WHERE d IS NOT NULL AND confidence = 'sure'""")
def honesty_curated(spark, sf):
    k = F.col("o_orderkey")
    entries = table(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 9 != 0, F.col("o_orderdate").cast("date")).alias("lastReviewed"), F.when(k % 5 != 0, k % 2 == 0).alias("verified"), F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("resolved"),
        F.when(k % 7 != 0, "u").alias("sourceUrl"), F.when(F.col("o_orderstatus") == "F", "fact").when(F.col("o_orderstatus") == "O", "contested").otherwise("sure").alias("confidence"), (k % 11 != 0).alias("has_values"),
    )
    return honesty.curated(entries, F.lit("1999-01-01").cast("date"))
