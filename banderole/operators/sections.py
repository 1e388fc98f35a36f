"""Blocks of lines under headings, tables inside them, and the best of several editions by additive rules.

A heading opens a block; the next heading, a terminator, a number of lines or the document's end closes it, and the block says which.
All of it happens inside a document's row, in time proportional to its lines, without a shuffle.

Edge cases: null texts have no blocks; a heading right before a terminator or another heading has a block of one line; lines ahead of the first heading
belong to nothing; CRLF ends a line as LF does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .figures import let


def blocks(docs: DataFrame, heading: str, *, end: str | None = None, most: int | None = None, text: str = "text") -> DataFrame:
    """``docs``' other columns with start (line number from 0), how it ended (heading, terminator, limit, end) and lines: one row a block, the heading first."""

    def of(lines: Column) -> Column:
        kind = lambda l: F.when(F.rlike(l, F.lit(heading)), "heading").when(F.rlike(l, F.lit(end)) if end else F.lit(False), "terminator")
        marked = F.filter(F.transform(lines, lambda l, i: F.struct(i.alias("i"), kind(l).alias("kind"))), lambda s: s["kind"].isNotNull())
        return let(marked, lambda stops: F.filter(F.transform(stops, lambda s, j: block(lines, s, F.get(stops, j + 1))), lambda b: b["kind"] == "heading"))

    def block(lines: Column, at: Column, stop: Column) -> Column:
        size = F.coalesce(stop["i"], F.size(lines)) - at["i"]
        cut = F.least(size, F.lit(most)) if most else size
        how = F.when(cut < size, "limit").otherwise(F.coalesce(stop["kind"], F.lit("end")))
        return F.struct(at["kind"].alias("kind"), at["i"].alias("start"), how.alias("how"), F.slice(lines, at["i"] + 1, cut).alias("lines"))

    found = docs.where(F.rlike(F.col(text), F.lit(f"(?m){heading}"))).withColumn("_b", let(F.split(F.col(text), "\r?\n"), of))
    kept = [c for c in docs.columns if c != text]
    return found.select(*kept, F.explode("_b").alias("_b")).select(*kept, "_b.start", "_b.how", "_b.lines")


def rows(lines: Column, pattern: str, names: list[str]) -> Column:
    """array of structs: the groups of each line that the whole pattern fits, in order."""
    hit = F.filter(lines, lambda l: F.rlike(l, F.lit(pattern)))
    return F.transform(hit, lambda l: F.struct(*(F.regexp_extract(l, pattern, k).alias(n) for k, n in enumerate(names, 1))))


def carried(lines: Column, label: str, value: str) -> Column:
    """array of (label, value): each value line with the last label above it in its block; a value ahead of any label has none."""

    def of(ls: Column) -> Column:
        heads = F.filter(F.transform(ls, lambda l, i: F.when(F.rlike(l, F.lit(label)), F.struct(i.alias("i"), F.regexp_extract(l, label, 1).alias("label")))), lambda s: s.isNotNull())
        values = F.filter(F.transform(ls, lambda l, i: F.when(F.rlike(l, F.lit(value)), F.struct(i.alias("i"), F.regexp_extract(l, value, 1).alias("value")))), lambda s: s.isNotNull())
        above = lambda hs, v: F.array_max(F.filter(hs, lambda h: h["i"] <= v["i"]))["label"]
        return let(F.struct(heads.alias("h"), values.alias("v")), lambda s: F.transform(s["v"], lambda v: F.struct(above(s["h"], v).alias("label"), v["value"].alias("value"))))

    return let(lines, of)


def money(cell: Column) -> Column:
    """Whole pounds of a cell; markers and dashes are null."""
    return F.regexp_replace(cell, "[£,\\s]", "").try_cast("double").cast("long")


MEDIANS = r"^\s*(\d{4})\s+(£[\d,]+|\.\.)\s+(£[\d,]+|\.\.)\s+(£[\d,]+|\.\.)\s+(£[\d,]+|\.\.)\s*$"
BANDS = ["deputy_director", "deputy_director_1a", "director", "director_general"]


def median_rows(lines: Column) -> Column:
    """array of (year, one amount a band) of a table of medians by pay band and year."""
    return F.transform(rows(lines, MEDIANS, ["year", *BANDS]), lambda r: F.struct(r["year"].cast("int").alias("year"), *(money(r[b]).alias(b) for b in BANDS)))


def correction_codes(notice: Column) -> Column:
    """The occupation codes that a correction notice names, each once and sorted; numbers of tables aren't codes."""
    named = F.regexp_extract_all(notice, F.lit(r"(?i)occupations?\s+([0-9,\s]+(?:and\s+[0-9]+)?)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(named, lambda m: F.regexp_extract_all(m, F.lit(r"(\d{2,4})"), F.lit(1))))))


# --- the best of several --------------------------------------------------------------------------
#: What tells a main report from its supplements, by its address and by its attachments.
EDITION_RULES = (("supplement|letter|remit|police|prison|armed|military|evidence|triennial|annex", -100), ("report", 10))
ATTACHMENT_RULES = (("supplement|letter|police|prison|military|armed forces|triennial|annex|evidence|summary|remit", -100), (r"\b(annual\s+)?report\b", 10), (r"\b\d{2}(st|nd|rd|th)\s+report\b", 15), ("accessible|web", 2))


def points(text: Column, rules: tuple[tuple[str, int], ...]) -> Column:
    """The sum of the points of all rules that a text fits, in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(F.rlike(low, F.lit(p)), n).otherwise(0) for p, n in rules), F.lit(0))


def edition_score(path: Column, year: Column, stem: str) -> Column:
    """Points of an edition's address; one that ends in the stem and the year has forty more."""
    exact = F.endswith(F.lower(path), F.concat(F.lit(stem), year.cast("string")))
    return points(path, EDITION_RULES) + F.when(exact, 40).otherwise(0)


def attachment_score(title: Column, url: Column, size: Column) -> Column:
    """Points of an attachment; each half megabyte counts one, twenty at most."""
    return points(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))), ATTACHMENT_RULES) + F.least(F.lit(20), F.floor(F.coalesce(size, F.lit(0)) / (500 * 1024) + 0.5)).cast("int")


def best(df: DataFrame, by: list[str], score: Column, *ties: Column) -> DataFrame:
    """The row of each group with the highest score, ``ties`` (higher first) deciding between equals; one grouped maximum, combined map-side."""
    kept = [c for c in df.columns if c not in by]
    order = F.struct(score.alias("score"), *(t.alias(f"t{i}") for i, t in enumerate(ties)))
    return df.groupBy(*by).agg(F.max_by(F.struct(*kept), order).alias("_x"), F.max(score).alias("score")).select(*by, "_x.*", "score")
