"""Published lists of high earners: three header shapes to one row shape.

A file's shape shows in its header alone: A has one combined pay cell and nothing about parents or
types, B has a floor and a ceiling column, C a combined cell again.  Bytes become cells in Arrow
batches; every rule on cells is a column of the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as c
from .posts_csv import file_rows, find_exact, norm_header, opened

# Header phrases of each field, the pay columns that tell the shapes apart.
RANGE = ("total pay floor and ceiling range", "pay floor and ceiling range")
FLOOR, CEIL, ANNUAL = ("total pay floor", "pay floor"), ("total pay ceiling", "pay ceiling"), ("annual pay rate",)
COMMON = {
    "org": ("organisation", "organization"),
    "title": ("job title", "post title"),
    "parent": ("parent department",),
    "org_type": ("type of organisation", "type of organization"),
}
ORG_TYPES = ("Civil Service", "Other central government", "Commercial enterprise in the public sector")
NON_EXECUTIVE, VERY_SENIOR = "Non-executive / chair", "NHS very senior manager"
RANKS = {
    "OF-6": ("brigadier", "commodore", "air commodore"),
    "OF-7": ("major general", "rear admiral", "air vice marshal"),
    "OF-8": ("lieutenant general", "lt general", "vice admiral", "air marshal"),
    "OF-9": ("general", "admiral", "air chief marshal"),
    "OF-10": ("field marshal", "admiral of the fleet", "marshal of the raf"),
}
NO_NAME = r"(?i)^([-—–.]+|n[/. ]?[ad]|not\s*(disclosed|published|provided|applicable)|non[- ]?disclos|withheld|undisclosed|vacan\w*|redact\w*|unknown|tbc|blank)$"

CELLS = ("org", "title", "parent", "org_type", "grade", "range", "floor", "ceil", "surname", "forename", "whole")
RAW = "file string, reason string, parser string, row_idx int, " + ", ".join(f"{x} string" for x in CELLS)


def shape_of(header: list[str]) -> str | None:
    """The header's shape, or None without pay columns."""
    floor, ceil = find_exact(header, FLOOR), find_exact(header, CEIL)
    if find_exact(header, RANGE) >= 0:
        return "C"
    if floor >= 0 <= ceil and floor != ceil:
        return "B"
    return "A" if find_exact(header, ANNUAL) >= 0 else None


def places(header: list[str], shape: str) -> dict[str, int]:
    """Which column holds each cell; -1 for what the shape doesn't publish."""
    norm = [norm_header(h) for h in header]
    at = {name: find_exact(header, phrases) if shape != "A" or name in ("org", "title") else -1 for name, phrases in COMMON.items()}
    at["grade"] = find_exact(header, ("grade",) if shape == "A" else ("grade equivalent", "grade"))
    at["range"] = {"A": find_exact(header, ANNUAL), "B": -1, "C": find_exact(header, RANGE)}[shape]
    at["floor"], at["ceil"] = (find_exact(header, FLOOR), find_exact(header, CEIL)) if shape == "B" else (-1, -1)
    at["surname"] = max((i for i, n in enumerate(norm) if n == "surname"), default=-1)
    at["forename"] = next((i for i, n in enumerate(norm) if n.startswith("forename")), -1)
    at["whole"] = next((i for i, n in enumerate(norm) if n == "name"), -1)
    return at


def raw_rows(files: DataFrame) -> DataFrame:
    """One row per data row of each (path, content), or one with the reason that a file was refused."""

    def of(path: str, content: bytes) -> Iterator[list]:
        head, rows = opened(content)
        shape = shape_of(head) if rows is not None else None
        at = places(head, shape) if shape else {}
        reason = "empty" if rows is None else "no-pay-columns" if not shape else "no-post-columns" if at["org"] < 0 and at["title"] < 0 else None
        if reason:
            yield [path, reason, *[None] * (len(CELLS) + 2)]
            return
        cell = lambda r, i: r[i].strip() if 0 <= i < len(r) else None if i < 0 else ""
        for k, r in enumerate(rows):
            yield [path, None, shape, k, *(cell(r, at[x]) for x in CELLS)]

    return file_rows(files, of, RAW)


def name(surname: Column, forename: Column, whole: Column) -> Column:
    """The published name, forename first, or null where the cell says that there is none."""
    clean = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "\\s+", " "))
    w, both = clean(whole), F.trim(F.concat_ws(" ", clean(forename), clean(surname)))
    full = F.when(w != "", w).otherwise(both)
    return F.when((full != "") & ~full.rlike(NO_NAME), F.substring(full, 1, 80))


def grade(raw: Column) -> Column:
    """struct(raw, band, variant): boards, very senior managers and ranks before the general rules."""
    n, g = c.normalised(raw), c.grade(raw)
    band, variant = g["band"], g["variant"]
    for code, ranks in RANKS.items():
        band, variant = F.when(n.isin(*ranks), c.MILITARY).otherwise(band), F.when(n.isin(*ranks), code).otherwise(variant)
    for own, pattern in ((VERY_SENIOR, f"very senior manager|{c.word('vsm')}"), (NON_EXECUTIVE, "^(non exec|nonexec|ned$|chair|deputy chair|vice chair|president of)|non executive")):
        band, variant = F.when(n.rlike(pattern), own).otherwise(band), F.when(~n.rlike(pattern), variant)
    return F.struct(g["raw"].alias("raw"), band.alias("band"), variant.alias("variant"))


def pay(lo: Column, hi: Column) -> Column:
    """struct(kind, floor, ceil): an open floor stays open, a lone ceiling is exact, edges are put in order."""
    a, b = c.half_up(c.positive(lo)), c.half_up(c.positive(hi))
    low, high = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.least(a, b)), F.when(b.isNotNull(), F.greatest(a, b))
    return F.struct(c.pay_shape(a, b).alias("kind"), low.alias("floor"), high.alias("ceil"))


def listed(raw: DataFrame) -> DataFrame:
    """The rows that aren't blank, typed; refused files give none."""
    blank = F.concat_ws("", "org", "title", "grade", "range", "floor", "ceil") == ""
    both = c.pay_range(F.col("range"))
    lo, hi = (F.when(F.col("parser") == "B", c.amount(F.col(x))).otherwise(both[y]) for x, y in (("floor", "lo"), ("ceil", "hi")))
    known = F.create_map(*(F.lit(x) for t in ORG_TYPES for x in (t.lower(), t)))
    kind = F.when(F.col("org_type") != "", F.coalesce(F.try_element_at(known, F.lower("org_type")), F.col("org_type")))
    rows = raw.where(F.col("reason").isNull() & ~blank).withColumns({"g": grade(F.col("grade")), "p": pay(lo, hi)})
    cut = lambda x, n: F.substring(F.coalesce(F.col(x), F.lit("")), 1, n).alias(x)
    return rows.select(
        "file", "row_idx", "parser", cut("org", 120), cut("parent", 120), kind.alias("org_type"), cut("title", 160),
        F.substring("g.raw", 1, 80).alias("raw_grade"), F.col("g.band").alias("band"), F.col("g.variant").alias("variant"),
        F.col("p.kind").alias("pay_kind"), F.col("p.floor").alias("floor"), F.col("p.ceil").alias("ceil"), name(F.col("surname"), F.col("forename"), F.col("whole")).alias("holder"),
    )


def file_stats(raw: DataFrame) -> DataFrame:
    """Per file: reason, parser, data, blank, unpublished and civil service rows, and types not on the list."""
    rows = listed(raw).groupBy("file").agg(
        F.count("*").alias("kept_rows"),
        F.count_if(F.col("pay_kind") == "not-published").alias("not_published"),
        F.count_if(F.coalesce(F.col("org_type") == ORG_TYPES[0], F.lit(False))).alias("civil_service"),
        F.sort_array(F.collect_set(F.when(~F.col("org_type").isin(*ORG_TYPES), F.col("org_type")))).alias("unknown_types"),
    )
    files = raw.groupBy("file").agg(F.max("reason").alias("gate"), F.max("parser").alias("parser"), F.count("row_idx").alias("data_rows"))
    out = files.join(rows, "file", "left").withColumn("kept_rows", F.coalesce("kept_rows", F.lit(0)))
    reason = F.coalesce("gate", F.when(F.col("kept_rows") == 0, "no-rows-survived"))
    return out.withColumns({"reason": reason, "blank_rows": F.col("data_rows") - F.col("kept_rows")}).drop("gate")


# The months of a title's date.
MONTHS = "january february march april may june july august september october november december".split()


def edition(title: Column) -> Column:
    """struct(key, year, ref_date, confidence) of an attachment's title; null without a year."""
    dated = r"(?i)as at\s+(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
    day, month, year = (F.regexp_extract(title, dated, k) for k in (1, 2, 3))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month))
    date = F.when(number > 0, F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")))
    plain = F.regexp_extract(title, r"(?<![A-Za-z0-9_])(20\d{2})(?![A-Za-z0-9_])", 1)
    shown = lambda key, y, d, how: F.struct(key.alias("key"), y.cast("int").alias("year"), d.alias("ref_date"), F.lit(how).alias("confidence"))
    return F.when(date.isNotNull(), shown(date, year, date, "declared")).when(plain != "", shown(plain, plain, F.lit(None).cast("string"), "year-only"))
