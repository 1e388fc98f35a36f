"""Pay statistics from the web pages of job titles: rows found by their label, three periods, places.

All columns are expressions over the page's text, so reading pages needs no shuffle; only the last of
repeated places takes a grouped pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import strict_count, strict_money
from ..operators.retrieval import stripped, table_rows

SECTION = "headline_statistics"
# The label that a figure's row has, or begins with.
WHOLE = {"n": ["number of salaries quoted"], "p10": ["10 th percentile", "10th percentile"], "p25": ["25 th percentile", "25th percentile"], "p75": ["75 th percentile", "75th percentile"], "p90": ["90 th percentile", "90th percentile"]}
BEGINS = {"median": "median annual salary", "ads": "permanent jobs requiring", "vacancies": "permanent vacancies in the uk", "ex_london_median": "uk excluding london median"}
COUNTS = ("n", "ads", "vacancies")
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed one time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def label(c: Column) -> Column:
    """A cell as a label: small letters, digits and per cent signs, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9%]+", " "))


def section(html: Column, name: str) -> Column:
    """The page from a section's start to that of the next; null where it has none."""
    return F.get(F.filter(F.split(html, "<section"), lambda x: x.startswith(f' id="{name}"')), F.lit(0))


def period(c: Column) -> Column:
    """struct(label, months, window_end) of "6 months to 15 Aug 2026"; parts that aren't there are null."""
    day = "([0-9]{1,2})\\s+([A-Za-z]{3})[A-Za-z]*\\s+([0-9]{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(c, day, 2)))
    end = F.concat_ws("-", F.regexp_extract(c, day, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(c, day, 1), 2, "0"))
    months = F.nullif(F.regexp_extract(c, "(?i)([0-9]+)\\s*months?", 1).try_cast("int"), F.lit(0))
    return F.when(c != "", F.struct(F.trim(F.regexp_replace(c, "\\s+", " ")).alias("label"), months.alias("months"), F.when(month > 0, end).alias("window_end")))


def _figures(rows: Column) -> Column:
    """``rows`` have a ``label``, made once a row, and ``cells``."""

    def cells(name: str) -> Column:
        fits = (lambda r: r["label"].isin(*WHOLE[name])) if name in WHOLE else (lambda r: r["label"].startswith(BEGINS[name]))
        return F.get(F.filter(rows, fits), F.lit(0))["cells"]

    def figure(found: Column, name: str, at: int) -> Column:
        return (strict_count if name in COUNTS else strict_money)(F.get(found[name], F.lit(at)))

    def gathered(x: Column) -> Column:
        periods = x["periods"]
        prior = F.array(*(F.struct(F.get(periods, F.lit(i)).alias("label"), figure(x, "n", i + 1).alias("n"), figure(x, "median", i + 1).alias("median")) for i in (1, 2)))
        return F.struct(F.coalesce(periods, F.array().cast("array<string>")).alias("periods"), *(figure(x, k, 1).alias(k) for k in (*WHOLE, *BEGINS)), prior.alias("prior"))

    head = F.get(F.filter(rows, lambda r: F.exists(r["cells"], lambda c: c.rlike("(?i)months to|same period"))), F.lit(0))["cells"]
    periods = F.filter(F.transform(F.slice(head, 2, 1000), F.trim), lambda c: c != "")
    return _once(F.struct(periods.alias("periods"), *(cells(k).alias(k) for k in (*WHOLE, *BEGINS))), gathered)


def summary(table: Column) -> Column:
    """A summary table's figures of its first period, and the count and median of the two before.

    The first row with a label counts; an unreadable, missing or zero amount is null, never zero.
    """
    rows = F.filter(table_rows(table), lambda r: F.size(r) > 0)
    return _once(F.transform(rows, lambda r: F.struct(label(F.get(r, F.lit(0))).alias("label"), r.alias("cells"))), _figures)


def title_pages(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, error, title, baseline, prose_median): a page's first two summary tables.

    The median in the section's sentence is read for comparison with that of the table.
    """
    head = section(F.col(html), SECTION)
    tables = F.transform(F.regexp_extract_all(head, F.lit('(?is)<table class="summary"[^>]*>(.*?)</table>'), F.lit(1)), summary)
    x = pages.select(key, F.explode(F.array(F.struct(head.alias("head"), tables.alias("tables")))).alias("x")).select(key, "x.*")
    title = F.get("tables", F.lit(0))
    error = F.when(F.col("head").isNull(), f"no {SECTION} section").when(F.size("tables") < 1, "no summary table").when(title["n"].isNull(), "summary table has no salary-count row")
    prose = _once(F.regexp_extract(stripped(F.col("head")), "(?i)median.{0,120}?salary in the UK is £([0-9,]+)", 1), strict_money)
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return x.withColumn("error", error).select(key, "error", fine(title).alias("title"), fine(F.get("tables", F.lit(1))).alias("baseline"), fine(prose).alias("prose_median"))


def places(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, place, ads, median): the places table, the last of repeated places."""
    table = F.regexp_extract(F.col(html), '(?is)<table class="tab tabLocations"[^>]*>(.*?)</table>', 1)
    rows = pages.select(key, F.posexplode(table_rows(table)).alias("pos", "r"))
    cell = lambda i: F.get("r", F.lit(i))
    named = rows.select(key, "pos", label(cell(0)).alias("place"), strict_count(cell(2)).alias("ads"), strict_money(cell(3)).alias("median")).where(~F.col("place").isin("", "location"))
    last = named.groupBy(key, "place").agg(F.max_by(F.struct("ads", "median"), "pos").alias("x"))
    return last.select(key, "place", "x.ads", "x.median")
