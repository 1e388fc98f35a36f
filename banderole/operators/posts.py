"""Posts across filings: identity, succession, trajectories, search, ranks and runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SCS_GRADES


def identity(df: DataFrame) -> DataFrame:
    """Add ``key``: organisation, reference and title, or title and unit where there is no reference."""
    named = F.concat_ws("|", "org", "pur", "title")
    loose = F.concat_ws("|", F.col("org"), F.concat(F.lit("~"), "title"), F.coalesce("unit", F.lit("")))
    has = F.coalesce(F.col("pur"), F.lit("")) != ""
    return df.withColumns({"key": F.when(has, named).otherwise(loose), "identity": F.when(has, "pur").otherwise("title-unit")})


def name_key(holder: Column) -> Column:
    """Names compared without case, spacing and punctuation."""
    return F.trim(F.regexp_replace(F.lower(holder), "[^a-z]+", " "))


def successions(points: DataFrame) -> DataFrame:
    """(key, holders): distinct names by first appearance, each in its latest spelling."""
    spelled = points.where(F.col("holder").isNotNull()).groupBy("key", name_key(F.col("holder")).alias("who")).agg(
        F.min(F.struct("date", "ordinal")).alias("first"), F.max_by("holder", F.struct("date", "ordinal")).alias("name")
    )
    return spelled.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "who", "name"))), lambda x: x["name"]).alias("holders"))


def group_posts(rows: DataFrame) -> DataFrame:
    """One row per post: first and last filing, latest and peak band, holders, counts.

    Everything is a mergeable aggregate, so a post with many filings is combined map-side.
    ``latest`` and ``peak`` need both edges; the earliest of equal peaks counts.
    """
    keyed = identity(rows)
    at = F.struct("date", "ordinal")
    both = F.col("disclosed") & F.col("floor").isNotNull() & F.col("ceil").isNotNull()
    band = F.struct(F.col("floor").alias("lo"), F.col("ceil").alias("hi"), F.col("date"))
    earliest = F.struct("ceil", (-F.datediff("date", F.lit("1970-01-01"))).alias("d"), (-F.col("ordinal")).alias("o"))
    grouped = keyed.groupBy("key").agg(
        F.max_by("org", at).alias("org"),
        F.max_by("identity", at).alias("identity"),
        F.max_by("title", at).alias("title"),
        F.max_by("unit", at).alias("unit"),
        F.max_by("grade", at).alias("grade"),
        F.max_by("prof", at).alias("prof"),
        F.max_by("holder", at).alias("last_holder"),
        F.count("*").alias("snapshots"),
        F.count_if(both).alias("disclosed_points"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max_by(F.when(both, band), F.when(both, at)).alias("latest"),
        F.max_by(F.when(both, band), F.when(both, earliest)).alias("peak"),
    )
    out = grouped.join(successions(keyed), "key", "left")
    return out.withColumn("holder", F.coalesce("last_holder", F.element_at("holders", -1))).drop("last_holder")


def trajectory(rows: DataFrame, least: int = 3) -> DataFrame:
    """(key, points): banded points in date order of posts with ``least`` of them."""
    both = identity(rows).where(F.col("disclosed") & F.col("floor").isNotNull() & F.col("ceil").isNotNull())
    points = F.array_sort(F.collect_list(F.struct("date", "ordinal", "floor", "ceil")))
    return both.groupBy("key").agg(points.alias("points")).where(F.size("points") >= least)


@dataclass(frozen=True)
class Search:
    text: str = ""
    orgs: tuple | None = None
    grades: tuple | None = None
    scs_only: bool = False
    disclosed_only: bool = False
    least_floor: int | None = None
    least_ceil: int | None = None
    first: str | None = None
    last: str | None = None
    sort: str = "latest_floor"
    limit: int = 50


def search(groups: DataFrame, s: Search) -> DataFrame:
    """Posts whose text holds every word, by the chosen order; ties by key.  Missing pay sorts last."""
    hay = F.lower(F.concat_ws(" ", "title", "unit", "grade", "prof", "org", "holders"))
    tests = [F.contains(hay, F.lit(w)) for w in s.text.lower().split()]
    tests += [F.col("org").isin(*s.orgs)] if s.orgs is not None else []
    tests += [F.col("grade").isin(*s.grades)] if s.grades is not None else []
    tests += [F.col("grade").isin(*SCS_GRADES)] if s.scs_only else []
    tests += [F.col("latest").isNotNull()] if s.disclosed_only else []
    tests += [F.col("latest.lo") >= s.least_floor] if s.least_floor is not None else []
    tests += [F.col("latest.hi") >= s.least_ceil] if s.least_ceil is not None else []
    tests += [F.col("last_date") >= s.first] if s.first else []
    tests += [F.col("first_date") <= s.last] if s.last else []
    out = groups
    for t in tests:
        out = out.where(t)
    pay = lambda c: F.coalesce(F.col(c), F.lit(-1)).desc()
    order = {
        "latest_floor": [pay("latest.lo"), pay("latest.hi")],
        "latest_ceil": [pay("latest.hi"), pay("latest.lo")],
        "peak_ceil": [pay("peak.hi"), pay("peak.lo")],
        "snapshots": [F.desc("snapshots")],
        "title": [F.collate("title", "UNICODE")],
    }[s.sort]
    return out.orderBy(*order, "key").limit(s.limit)


def top_earners(groups: DataFrame, *, at: str | None = None, limit: int = 50, grades: tuple | None = SCS_GRADES) -> DataFrame:
    """Highest published floors among posts whose span holds ``at``."""
    out = groups.where(F.col("latest").isNotNull())
    if grades is not None:
        out = out.where(F.col("grade").isin(*grades))
    if at:
        out = out.where((F.col("first_date") <= at) & (F.col("last_date") >= at))
    return out.orderBy(F.desc("latest.lo"), F.desc("latest.hi"), "key").limit(limit)


def certain_rank(df: DataFrame, floor: str = "floor", by: list[str] | None = None) -> DataFrame:
    """Add ``rank`` and ``tied``: a post certainly ranks behind those with a higher floor; equal
    floors share a rank."""
    over = Window.partitionBy(*(by or [F.lit(0)]))
    return df.withColumns({"rank": F.rank().over(over.orderBy(F.desc(floor))), "tied": F.count("*").over(Window.partitionBy(*(by or []), floor)) > 1})


def disclosure_runs(rows: DataFrame) -> DataFrame:
    """Islands: runs of consecutive filings of a post with or without a published band."""
    w = Window.partitionBy("key").orderBy("date", "ordinal")
    both = F.col("disclosed") & F.col("floor").isNotNull() & F.col("ceil").isNotNull()
    flagged = identity(rows).withColumn("shown", F.coalesce(both, F.lit(False)))
    turned = flagged.withColumn("turn", F.coalesce((F.col("shown") != F.lag("shown").over(w)).cast("int"), F.lit(0)))
    runs = turned.withColumn("run", F.sum("turn").over(w))
    return runs.groupBy("key", "run", "shown").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("filings"))


def top_with_other(df: DataFrame, value: str, group: str, keep: int = 4, *, again) -> DataFrame:
    """The ``keep`` groups with the highest value, and the rest re-aggregated by ``again`` as one
    query of its own: medians don't add up.  ``again`` gets the source with a bucket column."""
    ranked = df.groupBy(group).agg(F.max(value).alias("v")).orderBy(F.desc("v"), group).limit(keep).select(group)
    return again(F.broadcast(ranked.withColumn("bucket", F.col(group))))
