"""External comparators: gated figures, reviews, contested and restated values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_N = 30
STALE_MONTHS = 14


def figure(value: Column, n: Column, suppressed: Column, published: Column, as_of: Column, today: Column, corrected: Column) -> Column:
    """struct(ok, value, reason, caveats): the first gate that fails names the reason."""
    reason = F.when(suppressed.isNotNull(), "suppressed").when(~published | value.isNull(), "not-published").when(value == 0, "suppressed").when(n < LEAST_N, "insufficient")
    age = F.datediff(today, as_of) / 30.436875
    caveats = F.array_compact(F.array(F.when(n.isNull(), "n-unknown"), F.when(F.floor(age) > STALE_MONTHS, "stale"), F.when(corrected, "correction")))
    none = F.array().cast("array<string>")
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), value).alias("value"), reason.alias("reason"), F.when(reason.isNull(), caveats).otherwise(none).alias("caveats"))


def block_sha(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text, "\\s+", " ")), 256)


def review_state(blocks: DataFrame, approvals: DataFrame) -> DataFrame:
    """Each block's state against its approval: not-found, parse-empty, unreviewed, changed, verified;
    ``live`` values only from verified or just approved blocks."""
    joined = blocks.join(approvals.select("id", F.col("sha").alias("approved_sha")), "id", "left").withColumn("sha", block_sha(F.col("text")))
    state = (
        F.when(F.col("text").isNull(), "not-found")
        .when(F.col("parsed").isNull(), "parse-empty")
        .when(F.col("approve_now"), "approved-this-run")
        .when(F.col("approved_sha").isNull(), "unreviewed")
        .when(F.col("approved_sha") != F.col("sha"), "changed")
        .otherwise("verified")
    )
    out = joined.withColumn("state", state)
    return out.withColumn("live", F.when(F.col("state").isin("verified", "approved-this-run"), F.col("parsed")))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), (a + b) / 2)


def contested(left: DataFrame, right: DataFrame, on: list[str], value: str, limit: float = 0.2) -> DataFrame:
    """Pairs of sources whose values differ by more than the limit of their mean."""
    r = right.withColumnRenamed(value, "other")
    d = symmetric_difference(F.col(value), F.col("other"))
    return left.join(r, on).withColumn("difference", d).where(d > limit)


def restatements(readings: DataFrame, by: list[str], value: str = "pct") -> DataFrame:
    """Figures read at least twice with different values, and their spread."""
    return (
        readings.groupBy(*by)
        .agg(F.count("*").alias("readings"), F.countDistinct(value).alias("values"), (F.max(value) - F.min(value)).alias("spread"))
        .where("readings >= 2 and values >= 2")
    )


def sector_split(df: DataFrame, prefix: str) -> DataFrame:
    """Regions by prefix: "region," before the place."""
    return df.where(F.col("region").startswith(prefix + ","))


def editions(df: DataFrame, newest_revised: bool = False) -> DataFrame:
    """Per year the revised edition before the provisional one; of these the newest year."""
    w = Window.partitionBy("year").orderBy((F.col("kind") == "revised").desc())
    best = df.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    if newest_revised:
        best = best.where("kind = 'revised'")
    return best.orderBy(F.desc("year")).limit(1)


def annualised(weekly: Column) -> Column:
    return F.floor(weekly * 52 + 0.5).cast("long")


def edition_of(uri: Column) -> Column:
    """struct(year, kind) from "2024provisional" or "2023revised" in a link."""
    p = "(20[0-9]{2})(provisional|revised)"
    return F.struct(F.regexp_extract(uri, p, 1).try_cast("int").alias("year"), F.regexp_extract(uri, p, 2).alias("kind"))


def role_gate(ads: Column, median: Column) -> Column:
    """struct(status, median, reason) of an advertised role."""
    ok = (ads >= LEAST_N) & median.isNotNull()
    reason = F.when(median.isNull(), "no-median").when(F.coalesce(ads, F.lit(0)) < LEAST_N, "too-few-ads")
    return F.struct(F.when(ok, "ok").otherwise("insufficient").alias("status"), F.when(ok, median).alias("median"), F.when(~ok, reason).alias("reason"))
