"""Occupation codes of professions and grades, and the market pay that goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined_by(rows: DataFrame, professions: DataFrame, grades: DataFrame) -> DataFrame:
    """``rows`` with code, role, confidence: the profession's where it has one, else the grade's.

    ``professions``, ``grades``: curated lists (name, code, role, confidence), one row a name; rows of
    neither list have nulls.
    """
    side = lambda t, key: t.select(F.col("name").alias(key), F.struct("code", "role", "confidence").alias(f"by_{key}"))
    both = rows.join(side(professions, "prof"), "prof", "left").join(side(grades, "grade"), "grade", "left")
    return both.withColumn("by", F.coalesce("by_prof", "by_grade")).select(*rows.columns, "by.code", "by.role", "by.confidence")


def without_comparator(rows: DataFrame, professions: DataFrame) -> DataFrame:
    """(prof): the professions in use that the list doesn't know."""
    known = professions.select(F.col("name").alias("prof"))
    return rows.select("prof").where("prof is not null").distinct().join(known, "prof", "left_anti")


def market_pay(asked: DataFrame, crosswalk: DataFrame, figures: DataFrame) -> DataFrame:
    """(role, code, value, confidence, reason) of each asked role: its code's figure.

    A role without a code, and a code without a figure, say so in ``reason``; a match that is less than
    a fact lowers the figure's confidence to its own.
    """
    c = crosswalk.select("role", "code", F.col("confidence").alias("match"))
    x = asked.join(c, "role", "left").join(figures.select("code", "value", F.col("confidence").alias("own")), "code", "left")
    reason = F.when(F.col("code").isNull(), "no-crosswalk-entry").when(F.col("value").isNull(), "no-figure")
    sure = F.when(F.col("match") != "fact", F.col("match")).otherwise(F.col("own"))
    return x.select("role", "code", "value", F.when(reason.isNull(), sure).alias("confidence"), reason.alias("reason"))


def latest_units(posts: DataFrame, org: Column, unit: Column, most: int = 12) -> DataFrame:
    """(org, unit, posts, disclosed): the largest units of each organisation's latest filing.

    Posts that were abolished don't count.  Counted per unit first, so that the ranking sees units, not
    posts.
    """
    each = posts.where("status <> 'eliminated'").groupBy(org.alias("org"), "date", F.coalesce(unit, org).alias("unit")).agg(F.count("*").alias("posts"), F.count_if("disclosed").alias("disclosed"))
    last = posts.groupBy(org.alias("org")).agg(F.max("date").alias("date"))
    w = Window.partitionBy("org").orderBy(F.desc("posts"), "unit")
    ranked = each.join(last, ["org", "date"]).withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= most).select("org", "unit", "posts", "disclosed")
