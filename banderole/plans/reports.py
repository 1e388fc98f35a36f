"""Figures in report pages: pages are drawn from the parts table, the SQL gives the values that were drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import figures
from ..store import once
from .stand_in import query, spread, table

YEARS = ((20, 2022), (40, 2023), (70, 2022), (90, 2023))
SERIES = (("Deputy director Private", "Deputy director Public"), ("Director Private", "Director Public"))
BAND_AT = ((20, "Deputy director 1A"), (50, "Director"), (80, "Permanent secretary"))


def _label(i: int):
    return -((F.floor("p_retailprice") + 37 * i) % 90 + 5)


def pages_of(spark, sf) -> DataFrame:
    """A page for every part, by key modulo 7: no legend (0), bands along the axis (1), a label missing (2), a stray label (3), no figure (4), whole charts (5, 6)."""
    kind = F.col("p_partkey") % 7
    pct = lambda i: F.concat(_label(i).cast("string"), F.lit("%"))

    def line(tick: int | None, end: int, text) -> object:
        return F.concat(F.lpad(F.lit("" if tick is None else f"{tick}%"), 8, " "), F.lpad(text, end - 8, " "))

    labels = []
    for g, (x, _) in enumerate(YEARS):
        for j, off in enumerate((-1, 7)):
            gone = (kind == 2) if (g, j) == (1, 0) else F.lit(False)
            labels.append(F.when(gone, F.lpad(F.lit(f"{-10 * len(labels)}%"), 8, " ")).otherwise(line(-10 * len(labels), x + off, pct(2 * g + j))))
    stray = F.when(kind == 3, line(None, 29, F.lit("-99%")))
    caption = F.concat(F.lit("Figure "), (F.col("p_partkey") % 5).cast("string"), F.lit(".7: Percentage difference in total remuneration between the SCS and private"))
    legend = F.when(kind != 0, F.lit("      " + "     ".join(s for pair in SERIES for s in pair)))
    axis = F.lit("".join(" " * (x - (YEARS[k - 1][0] + 4 if k else 0)) + str(y) for k, (x, y) in enumerate(YEARS)))
    tail = F.lit("Source: unpublished  data\nNote: medians\nof salaries")
    years = F.concat_ws("\n", F.lit("Chapter 3 has 12% of the pages.\n"), caption, F.lit("and public sectors"), legend, *labels, stray, axis, tail)
    cats = F.lit("".join(" " * (x - (BAND_AT[k - 1][0] + len(BAND_AT[k - 1][1]) if k else 0)) + s for k, (x, s) in enumerate(BAND_AT)))
    ticks = F.lit("\n".join(f"{-10 * k}%".rjust(8) for k in range(6)))
    bands = F.concat_ws("\n", F.lit("Figure 4.1: Salary comparison: median pay in the SCS and the private sector, 2024"), F.lit(""), ticks, *(line(None, x + 3, pct(k)) for k, (x, _) in enumerate(BAND_AT)), line(None, 118, F.lit("-77%")), cats, tail)
    text = F.when(kind == 1, bands).when(kind == 4, F.lit("Nothing drawn here, 40% or not.\n2022 2023")).otherwise(years)
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("page"), F.explode(F.array(text)).alias("text"))  # filters on the text stay above this, so they run in all partitions


_VALUES = f"""v AS (SELECT p_partkey AS page, p_partkey % 7 AS kind, list_transform(range(8), lambda i: -CAST((CAST(floor(p_retailprice) AS BIGINT) + 37 * i) % 90 + 5 AS INTEGER)) AS v FROM part),
drawn AS (SELECT page, kind, v, g, j FROM v, LATERAL (SELECT unnest(range(4)) AS g), LATERAL (SELECT unnest([0, 1]) AS j)),
readings AS (SELECT page, CAST(page % 5 AS VARCHAR) || '.7' AS figure_no, (['{"', '".join(s for pair in SERIES for s in pair)}'])[(g // 2) * 2 + j + 1] AS series, CAST(2022 + g % 2 AS INTEGER) AS year, v[2 * g + j + 1] AS pct
  FROM drawn WHERE kind IN (2, 3, 5, 6) AND NOT (kind = 2 AND g = 1)
  UNION ALL SELECT page, '4.1', (['{"', '".join(s for _, s in BAND_AT)}'])[i + 1] || ' Private', 2024, v[i + 1] FROM v, LATERAL (SELECT unnest(range(3)) AS i) WHERE kind = 1)"""


@query(f"WITH {_VALUES} SELECT page, figure_no, series, year, pct FROM readings")
def gap_figure_points(spark, sf):
    return figures.points(figures.read(pages_of(spark, sf)), "page")


@query(f"""WITH {_VALUES} SELECT page, CASE WHEN kind <> 0 THEN 'year' END IS NOT NULL AS readable, CASE WHEN kind = 0 THEN NULL WHEN kind = 1 THEN 'band-axis' ELSE 'year-axis' END AS shape,
  CASE WHEN kind = 0 THEN 'no legend; no year in the caption' END AS refused, 'Source: unpublished data' AS source, 'Note: medians of salaries' AS note,
  CASE WHEN kind = 1 THEN 'Salary comparison: median pay in the SCS and the private sector, 2024' ELSE 'Percentage difference in total remuneration between the SCS and private and public sectors' END AS caption FROM v WHERE kind <> 4""")
def gap_figures(spark, sf):
    out = figures.read(pages_of(spark, sf))
    return out.select("page", F.col("refused").isNull().alias("readable"), "shape", "refused", "source", "note", "caption")


@query(f"""WITH {_VALUES} SELECT page, 2023 AS year, v[4] AS pct, 47 AS x FROM v WHERE kind = 2
UNION ALL SELECT page, 2022, -99, 29 FROM v WHERE kind = 3 UNION ALL SELECT page, 2024, -77, 118 FROM v WHERE kind = 1""")
def gap_figure_loose(spark, sf):
    return figures.read(pages_of(spark, sf)).select("page", F.inline("loose"))


@query(f"""WITH {_VALUES} SELECT page AS edition, series, year, pct + CASE WHEN page % 3 = 0 THEN 1 ELSE 0 END AS pct, CAST(pct AS INTEGER) AS got FROM readings WHERE page % 3 = 0
UNION ALL SELECT page, 'Director Private', 2023, CAST(-50 AS INTEGER), NULL FROM v WHERE kind = 0""")
def gap_figure_anchors(spark, sf):
    """A third of the anchors say one more than is drawn; charts that can't be read miss theirs."""
    read = once(figures.points(figures.read(pages_of(spark, sf)), "page").withColumnRenamed("page", "edition"))
    wrong = read.select("edition", "series", "year", (F.col("pct") + (F.col("edition") % 3 == 0).cast("int")).alias("pct"))
    missing = table(spark, sf, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("edition"), F.lit("Director Private").alias("series"), F.lit(2023).alias("year"), F.lit(-50).alias("pct"))
    return figures.broken_anchors(read, wrong.unionByName(missing)).select("edition", "series", "year", "pct", "got")
