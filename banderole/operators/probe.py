"""Probing lost files: staged verdicts, halves put together, and a state that later runs carry on from.

A verdict is the first stage that ends a file: out of scope, not in the archive, no readable body, not parsed as one
row, then what the parser says.  Files of posts without pay wait for their other half: within an organisation and date each takes the free file
that matches best, in the order of the list, and a half that is taken is gone.

Runs carry state: an item is probed again only if what it is judged by has changed (``fingerprint``), so a run over the same
inputs probes nothing.  State is a table; ``merged`` gives the next one, to be published like any other.

Edge cases: an item that no stage knows has no verdict yet and stays pending; null organisations or dates have no halves in common;
equal match rates go to the least url; repeated items count once, by their least columns; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import discard, new_path, written

LEAST_RATE = 0.5
STATE = "url string, fingerprint string, status string, detail string, run long"


def fingerprint(*inputs: Column) -> Column:
    """A digest of what a verdict rests on; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in inputs))), 256)


def verdicts(items: DataFrame, resolved: DataFrame, bodies: DataFrame, parsed: DataFrame, *, out_of_scope: dict[str, str] | None = None) -> DataFrame:
    """(url, org, date, origin, timestamp, sha256, status, detail) of (url, org, date, reason) items.

    ``resolved``: (url, origin, timestamp, reason); ``bodies``: (url, ok, reason, detail, sha256); ``parsed``: (url, ok, reason, rows, columns).
    A file of one row with more than 50 columns has lost its line ends.
    """
    scope = F.lit(None).cast("string")
    for reason, why in (out_of_scope or {}).items():
        scope = F.when(F.col("i.reason") == reason, F.lit(why)).otherwise(scope)
    one = items.groupBy("url").agg(F.min(F.struct("org", "date", "reason")).alias("x")).select("url", "x.*")
    df = one.alias("i").join(resolved.alias("r"), "url", "left").join(bodies.alias("b"), "url", "left").join(parsed.alias("p"), "url", "left")
    wide = (F.col("p.rows") == 1) & (F.col("p.columns") > 50)
    status = (
        F.when(scope.isNotNull(), "out-of-scope").when(F.col("r.reason").isNotNull(), F.col("r.reason")).when(~F.col("b.ok"), F.col("b.reason"))
        .when(wide, "lone-cr-not-normalised").when(F.col("p.ok"), "ok").otherwise(F.col("p.reason"))
    )
    detail = F.when(scope.isNotNull(), scope).when(~F.col("b.ok"), F.col("b.detail")).when(wide, F.concat(F.lit("1 row x "), F.col("p.columns").cast("string"), F.lit(" columns")))
    return df.select("url", "i.org", "i.date", "r.origin", "r.timestamp", "b.sha256", status.alias("status"), F.when(F.col("r.reason").isNull() | scope.isNotNull(), detail).alias("detail"))


def halves(posts: DataFrame, rates: DataFrame, *, least: float = LEAST_RATE) -> DataFrame:
    """(url, pay, rate, status) of files of posts, in their order: joined, pay-join-too-sparse or no-pay-file-found.

    ``posts``: (url, org, date, place); ``rates``: (url, pay, rate) of the files that it may be joined with.  The k-th file of every
    organisation and date chooses in round k, so there are as many rounds as files of one organisation and date.  A round reads its own
    offers alone, from a table that is written once in the order of the rounds, and appends its choices to those before.
    """
    spark, turn = posts.sparkSession, Window.partitionBy("org", "date").orderBy("place", "url")
    waiting, path = written(posts.select("url", F.row_number().over(turn).alias("turn")), "halves")
    most = waiting.agg(F.max("turn")).first()[0] or 0
    if not most:
        return posts.select("url", F.lit(None).cast("string").alias("pay"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("string").alias("status")).where("false")
    offers, offered = written(rates.join(waiting.hint("merge"), "url").select("turn", "url", "pay", "rate").sortWithinPartitions("turn"), "halves-offers")
    done, at = None, new_path(spark, "halves-done")
    for k in range(1, most + 1):
        free = offers.where(F.col("turn") == k)
        if done is not None:
            free = free.join(done.where("status = 'joined'").select("pay").hint("merge"), "pay", "left_anti")
        best = free.groupBy("url").agg(F.min(F.struct((-F.col("rate")).alias("least"), "pay", "rate")).alias("b")).select("url", "b.pay", "b.rate")
        status = F.when(F.col("rate").isNull(), "no-pay-file-found").when(F.col("rate") < least, "pay-join-too-sparse").otherwise("joined")
        chosen = waiting.where(F.col("turn") == k).select("url").join(best.hint("merge"), "url", "left").withColumn("status", status)
        chosen.write.mode("append").parquet(at)
        done = spark.read.schema(chosen.schema).parquet(at)
    discard(path, offered)
    return done


def pending(items: DataFrame, state: DataFrame, inputs: list[str]) -> DataFrame:
    """Items whose verdict isn't known, or rests on other inputs than now, with their ``fingerprint``."""
    now = items.withColumn("fingerprint", fingerprint(*(F.col(c) for c in inputs)))
    return now.join(state.select("url", "fingerprint"), ["url", "fingerprint"], "left_anti")


def merged(state: DataFrame, judged: DataFrame, run: int) -> DataFrame:
    """The state after a run: its verdicts in place of older ones; files without a verdict stay out, so that they are tried again."""
    new = judged.where("status is not null").select("url", "fingerprint", "status", "detail", F.lit(run).cast("long").alias("run"))
    return state.select(*new.columns).join(new.select("url"), "url", "left_anti").unionByName(new)


def reports(state: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recovered, unrecovered): files that were read or put together with their kind; the others with their reason and how many share it."""
    pairs = joined.where("status = 'joined'").select("url", "pay")
    pay = pairs.select(F.col("pay").alias("url"), F.lit(True).alias("taken"))
    df = state.join(pairs, "url", "left").join(pay, "url", "left")
    kind = F.when(F.col("pay").isNotNull(), "joined").when(F.col("taken"), "pay-side").when(F.col("status") == "ok", "verbatim")
    df = df.withColumn("kind", kind)
    lost = df.where("kind is null").join(joined.where("status <> 'joined'").select("url", F.col("status").alias("late")), "url", "left").select("url", F.coalesce("late", "status").alias("reason"), "detail")
    counts = lost.groupBy("reason").agg(F.count("*").alias("files"))
    return df.where("kind is not null").select("url", "kind", "pay", "run"), lost.join(counts, "reason").select("url", "reason", "detail", "files")
