"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only.

A source's documents, in hash order, form blocks.  Every block gets a release slot and a deadline
slot from its source's weight, and the earliest deadline first among released blocks fills the slots
(``pfair``), so that each source stays within one block of its share at every slot.  When a source
runs out, its weight goes to the rest in proportion.  The schedule is the same exact one for any
number of sources; it is a table that Spark makes and joins.

Ranks inside a source come from two levels (hash buckets, then rows of a bucket), so no task holds
a whole source.  Only totals over all sources reach the driver.

Edge cases: a null source is the source with the empty name; rows without an id or with a repeated
one are placed by all their columns, so no id fills a bucket (only rows that are equal in all columns
meet in one; the window over a bucket streams); a source without a weight gets the least one given;
an empty table gives no rows; all columns pass through, but for names that start with ``_mix_``,
which are reserved and replaced.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pfair
from .store import shuffle_partitions, written

POWER = 0.7  # of a source's rows, in its target weight

def tempered(counts: dict[str, int], power: float = POWER) -> dict[str, float]:
    """Target weights between the natural ones (power 1) and equal ones (power 0)."""
    return {s: n**power for s, n in counts.items()}


def _sources(rows: DataFrame, weights: dict[str, float] | None, block_rows: int, period: int) -> tuple[DataFrame, int]:
    """A table of (s, n blocks, w whole weight of at most ``period``), and the rows of all sources."""
    counts = rows.groupBy(F.col("_mix_source").alias("s")).agg(F.count(F.lit(1)).alias("rows"))
    if weights:
        given = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(weights)), "map<string,double>")).alias("s", "weight"))
        counts = counts.join(given, "s", "left").withColumn("weight", F.coalesce("weight", F.lit(float(min(weights.values())))))
    else:
        counts = counts.withColumn("weight", F.pow("rows", F.lit(POWER)))
    counts, _ = written(counts, "mix-sources")
    total, most = counts.agg(F.sum("rows"), F.max("weight")).first()
    whole = F.greatest(F.lit(1), F.floor(F.col("weight") / F.lit(most or 1.0) * period)).cast("long")
    return counts.select("s", F.ceil(F.col("rows") / block_rows).cast("long").alias("n"), whole.alias("w")), total or 0


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, *, key: str = "doc_id", source: str = "source", block_rows: int = 16, period: int = 1 << pfair.UNIT, bucket_rows: int = 2048, seed: int = 17
) -> DataFrame:
    """``docs`` with _mix_block, _mix_rank (row in its source), _mix_slot, _mix_release, _mix_deadline.

    Sorting by (_mix_slot, _mix_rank) gives the mixed order.  Without ``weights``, those of ``tempered``.
    Weights become whole numbers, the largest of them ``period`` (at most 2 ** 30), none less than one.
    """
    if not 0 < period <= 1 << pfair.UNIT:
        raise ValueError(f"period must be 1 to 2 ** {pfair.UNIT}")
    docs = docs.drop(*(c for c in docs.columns if c.lower().startswith("_mix_")))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumns({"_mix_source": F.coalesce(F.col(source).cast("string"), F.lit("")), "_mix_hash": F.xxhash64(F.col(key), F.lit(seed), *hashed)})
    sources, total = _sources(rows, weights, block_rows, period)

    bits = max(0, math.ceil(math.log2(max(1, total / bucket_rows))))
    rows = rows.withColumn("_mix_bucket", F.shiftrightunsigned("_mix_hash", 64 - bits) if bits else F.lit(0).cast("long"))
    group = ["_mix_source", "_mix_bucket"]
    before = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_mix_first"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("_mix_hash", key)) - 1
    ranked = rows.withColumn("_mix_in", inside).join(firsts, group)
    ranked = ranked.withColumn("_mix_rank", F.col("_mix_first") + F.col("_mix_in")).withColumn("_mix_block", F.floor(F.col("_mix_rank") / block_rows).cast("long"))

    names = {"s": "_mix_source", "j": "_mix_block", "slot": "_mix_slot", "r": "_mix_release", "d": "_mix_deadline"}
    plan = pfair.schedule(sources).select(*(F.col(a).alias(b) for a, b in names.items()))
    return ranked.join(plan, ["_mix_source", "_mix_block"]).drop("_mix_source", "_mix_hash", "_mix_bucket", "_mix_first", "_mix_in")


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, **kw) -> DataFrame:
    """All rows of ``docs``, range-partitioned and sorted by their place in the mix."""
    mixed = mix(docs, weights, **kw)
    n = shuffle_partitions(docs.sparkSession)
    return mixed.repartitionByRange(n, "_mix_slot", "_mix_rank").sortWithinPartitions("_mix_slot", "_mix_rank").select(*docs.columns)


def deviation(order: list[str], weights: dict[str, float]) -> Fraction:
    """The largest |blocks given - share due| over all prefixes; for tests."""
    total, have, worst = sum(weights.values()), dict.fromkeys(weights, 0), Fraction(0)
    for t, s in enumerate(order, 1):
        have[s] += 1
        worst = max(worst, *(abs(have[x] - Fraction(weights[x]) / total * t) for x in weights))
    return worst
