"""Recovering lost files from a web archive: what to try, where redirects lead, what became of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import once

MOST_HOPS = 3


def _first(tables: list[DataFrame], columns: list[str], latest: bool) -> DataFrame:
    """One row a url out of several tables, by the tables' order; a grouped minimum or maximum, combined map-side."""
    both = reduce(DataFrame.unionByName, (t.select("url", *columns, F.lit(i).alias("place")) for i, t in enumerate(tables)))
    pick = (F.max if latest else F.min)(F.struct("place", *columns))
    return both.groupBy("url").agg(pick.alias("x")).select("url", *(F.col("x")[c].alias(c) for c in columns))


def work_list(failures: DataFrame, tried: DataFrame, asked: DataFrame, resources: DataFrame, siblings: DataFrame) -> DataFrame:
    """(url, org, date, reason): each url once: failures, then earlier attempts, then urls asked for.

    ``failures``, ``asked``: (url, org, date, reason); ``tried`` has ``kind`` besides, and files of the
    pay side aren't tried again.  Organisation and date come from what the last build says of the url:
    its failures before its rejected siblings before its resources, (url, org, date) each.  A build
    without a date leaves the item's own.  Of several rows for a url in one table the least is the item,
    the greatest the attribution, by their columns in this order.
    """
    again = tried.where(~F.col("kind").eqNullSafe("pay-side")).withColumn("reason", F.coalesce("reason", F.lit("previously-attempted")))
    items = _first([failures, again, asked], ["org", "date", "reason"], latest=False)
    said = _first([resources, siblings, failures], ["org", "date"], latest=True).select("url", F.col("org").alias("said_org"), F.col("date").alias("said_date"), F.lit(True).alias("said"))
    joined = items.join(said, "url", "left")
    return joined.select("url", F.when(F.col("said"), F.col("said_org")).otherwise(F.col("org")).alias("org"), F.coalesce("said_date", "date").alias("date"), "reason")


def within(items: DataFrame, orgs: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Items of some organisations and dates; an item without a date is never out of the dates."""
    tests = [F.upper("org").isin(*(o.upper() for o in orgs))] if orgs else []
    tests += [F.col("date").isNull() | (F.col("date") >= first)] if first else []
    tests += [F.col("date").isNull() | (F.col("date") <= last)] if last else []
    return items.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def resolve(urls: DataFrame, captures: DataFrame, redirects: DataFrame, *, inside: Column | None = None) -> DataFrame:
    """(url, origin, timestamp, hops, reason): each url followed over up to three redirects to a capture.

    ``captures``: (url, timestamp), one usable capture a url at most; ``redirects``: (url, target), one
    row for each url with any other capture, without a target where none redirects.  ``reason`` is null
    where a capture was found, else no-capture (the archive never saw the url) or only-redirects.  A
    target seen before, one that isn't a web address, and one that is ``inside`` the archive end the
    chase.  A hop joins all urls still under way and is written once, for its ends and for the next hop.
    """
    known = captures.select(F.col("url").alias("at"), "timestamp")
    onward = redirects.select(F.col("url").alias("at"), "target", F.lit(True).alias("seen"), (F.lit(False) if inside is None else inside).alias("stop"))
    under_way, done = urls.select("url", F.col("url").alias("at"), F.array("url").alias("chain")).distinct(), []
    for hop in range(MOST_HOPS + 1):
        looked = once(under_way.join(known, "at", "left").join(onward, "at", "left"))
        ends = F.col("timestamp").isNotNull()
        goes = ~ends & F.coalesce(F.col("target").rlike("(?i)^https?://"), F.lit(False)) & ~F.coalesce(F.col("stop"), F.lit(True)) & ~F.coalesce(F.array_contains("chain", F.col("target")), F.lit(True))
        if hop == MOST_HOPS:
            goes = F.lit(False)
        lost = F.when(F.col("seen").isNull() & F.lit(hop == 0), "no-capture").otherwise("only-redirects")
        done.append(looked.where(~goes).select("url", F.when(ends, F.col("at")).alias("origin"), "timestamp", F.lit(hop).alias("hops"), F.when(~ends, lost).alias("reason")))
        under_way = looked.where(goes).select("url", F.col("target").alias("at"), F.array_append("chain", F.col("target")).alias("chain"))
    return reduce(DataFrame.unionByName, done)


def downstream(recovered: DataFrame, resources: DataFrame, siblings: DataFrame) -> DataFrame:
    """``recovered`` with ``downstream``, what the last build made of each file, and the reason of a drop."""
    used = resources.select("url").distinct().withColumn("used", F.lit(True))
    dropped = siblings.groupBy("url").agg(F.max("reason").alias("downstream_reason"), F.lit(True).alias("dropped"))
    state = F.when(F.col("used"), "in-corpus").when(F.col("dropped"), "dropped-by-ingest").otherwise("not-yet-ingested")
    return recovered.join(used, "url", "left").join(dropped, "url", "left").withColumn("downstream", state).drop("used", "dropped")


def not_ingested(files: DataFrame, resources: DataFrame) -> DataFrame:
    """Files that no build has read: those alone may be joined into something."""
    return files.join(resources.select("url").distinct(), "url", "left_anti")
