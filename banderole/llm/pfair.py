"""A Pfair schedule of any number of sources, in whole numbers and DataFrame functions only.

Source s has n blocks and the whole weight w.  In virtual time v it has been given min(v * w, n)
blocks' worth of service; all sources together T(v) = sum of min(v * w, n), which is real time, so the
weights of sources that run out go to the rest in proportion.  Block j is released at slot
floor(T(j / w)) and due at slot ceil(T((j + 1) / w)).  Giving every slot to the released block that
is due first (ties: smaller source) meets every deadline, and a block inside its window keeps its
source within one block of its share at every slot.

That rule is a chain over slots, but it splits.  Slots form a binary tree; the *basis* of a node is
what the rule would run inside it of the blocks released inside it.  Going up, a node's basis is its
left child's and the first-due of (left's remainder, right's basis), as many as the right child has
slots.  Going down, of the blocks that a node runs, its left child runs the first-due of (left's
basis, blocks released before the node), the right child the others.  Each block falls one level at
a time until its node is its slot.  Nothing is approximate: the result is that of the chain.

Levels inside a chunk of slots are windows over one shuffle.  Above a chunk, one level is one written
round, and only blocks whose windows reach over the boundary in question are ranked: at most one a
source.  That bounds a task; the driver sees four totals.  Work grows with blocks * log(blocks).

Edge cases: no rows, no schedule; equal sources are told apart by name; weights below one count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, shuffle_partitions, written

CHUNK_BITS = 12  # slots of a chunk: 2 ** 12
SPAN = 1 << 16  # blocks that one row unfolds to
UNIT = 30  # weights have at most this many bits, so that products of two fit a long


def points(sources: DataFrame) -> DataFrame:
    """(s, n, w, k, v, f) for the end of each source's k-th block: virtual time k / w is v + f / 2 ** 60.

    Different fractions of denominators up to 2 ** 30 differ by at least 2 ** -60, so (v, f) sorts
    and ties exactly as k / w does.
    """
    parts = shuffle_partitions(sources.sparkSession)
    spans = sources.withColumn("k0", F.explode(F.expr(f"sequence(0L, n - 1, {SPAN}L)"))).repartition(parts, "s", "k0")
    each = spans.withColumn("k", F.explode(F.expr(f"sequence(k0 + 1, least(k0 + {SPAN}, n))"))).drop("k0")
    high = f"shiftleft(k % w, {UNIT})"
    return each.withColumns({"v": F.expr("k div w"), "f": F.expr(f"shiftleft({high} div w, {UNIT}) + shiftleft({high} % w, {UNIT}) div w")})


def windows(sources: DataFrame) -> DataFrame:
    """(s, j, r, d): each block's release and deadline.  ``sources`` is a table of (s, n, w)."""
    spark = sources.sparkSession
    weight = sources.agg(F.sum("w")).first()[0] or 0
    # Sums over all smaller virtual times: of whole ranges first, then inside a range.
    ended = {"end_n": F.when(F.expr("k = n"), F.col("n")).otherwise(0), "end_w": F.when(F.expr("k = n"), F.col("w")).otherwise(0)}
    ranged = points(sources).withColumns(ended).repartitionByRange(shuffle_partitions(spark), "v", "f")
    table, path = written(ranged.withColumn("part", F.spark_partition_id()), "pfair-points")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = table.groupBy("part").agg(F.sum("end_n").alias("a"), F.sum("end_w").alias("b"))
    sums = sums.select("part", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in ("a", "b")))
    inside = Window.partitionBy("part").orderBy("v", "f")  # up to and with equal virtual times
    seen = table.withColumns({"a": F.sum("end_n").over(inside), "b": F.sum("end_w").over(inside)}).join(F.broadcast(sums), "part")
    # T(k / w) = a + (k / w) * b with a the blocks of sources that have ended, b the weight of the rest.
    timed = seen.withColumns({"a": F.expr("a0 + a"), "b": F.expr(f"{weight} - b0 - b"), "m": F.expr("k % w")})
    timed = timed.withColumns({"low": F.expr("a + v * b + m * (b div w) + (m * (b % w)) div w"), "more": F.expr("cast((m * (b % w)) % w > 0 as long)")})
    ends = F.expr("inline(array(struct(k - 1 as j, cast(null as long) as r, low + more as d), struct(k as j, low as r, cast(null as long) as d)))")
    halves = timed.select("s", "n", ends).where("j < n")
    blocks, _ = written(halves.groupBy("s", "j").agg(F.coalesce(F.max("r"), F.lit(0)).alias("r"), F.max("d").alias("d")), "pfair-blocks")
    discard(path)
    return blocks


def _bit(level: int) -> Column:
    """Whether the block is in the basis of its node at this level."""
    return F.expr(f"shiftright(basis, {level}) & 1L = 1L")


def _with(basis: Column, level: int) -> Column:
    return F.col("basis") + F.when(basis, F.lit(1 << level)).otherwise(F.lit(0))


def _first_due(*by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy("d", "s"))


def _ranked_at_boundary(table: DataFrame, node: Column, sure: Column, open_: Column, half: int) -> tuple[DataFrame, Column]:
    """The open rows of each node, and whether one is among those that still find a place beside the sure ones."""
    counts = table.where(sure).groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("sure"))
    rows = table.where(open_).withColumn("node", node).join(counts, "node", "left").withColumn("rank", _first_due("node"))
    return rows, F.col("rank") <= half - F.coalesce("sure", F.lit(0))


def schedule(sources: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(s, j, r, d, slot) of every block of ``sources`` (s string, n long, w long): a written table."""
    blocks = windows(sources)
    total = sources.agg(F.sum("n")).first()[0] or 0
    top = max(1, (total - 1).bit_length())
    low = min(top, chunk_bits)
    columns = ["s", "j", "r", "d", "basis"]

    # Up: bases inside chunks.
    table = blocks.withColumn("chunk", F.shiftright("r", low)).repartition("chunk")
    table = table.withColumn("basis", F.when(_first_due("chunk", "r") == 1, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    for level in range(1, min(low, top - 1) + 1):
        left = F.expr(f"shiftright(r, {level - 1}) & 1L = 0L")
        table = table.withColumns({"node": F.shiftright("r", level), "asks": left != _bit(level - 1)})
        table = table.withColumn("rank", _first_due("chunk", "node", "asks"))
        table = table.withColumn("basis", _with(F.when(F.col("asks"), F.col("rank") <= 1 << (level - 1)).otherwise(_bit(level - 1)), level))
    table, path = _round(table.select(*columns), None)

    # Up: bases of nodes above chunks.
    for level in range(low + 1, top):
        left, end = F.expr(f"shiftright(r, {level - 1}) & 1L = 0L"), F.expr(f"shiftleft(shiftright(r, {level}) + 1, {level})")
        asks = left != _bit(level - 1)
        open_ = asks & (F.col("d") > end)
        rows, fits = _ranked_at_boundary(table, F.shiftright("r", level), asks & (F.col("d") <= end), open_, 1 << (level - 1))
        rest = table.where(~open_).withColumn("basis", _with(asks | _bit(level - 1), level))
        table, path = _round(rest.select(*columns).unionByName(rows.withColumn("basis", _with(fits, level)).select(*columns)), path)

    # Down: the node that runs a block, from the root to chunks.
    table = table.withColumn("slot", F.lit(0).cast("long"))
    columns.append("slot")
    for level in range(top, low, -1):
        early, late, asks = _sides(level)
        open_ = ~early & ~late & asks
        rows, fits = _ranked_at_boundary(table, F.col("slot"), early, open_, 1 << (level - 1))
        rest = table.where(~open_).withColumn("slot", _child(early))
        table, path = _round(rest.select(*columns).unionByName(rows.withColumn("slot", _child(fits)).select(*columns)), path)

    # Down: inside chunks.
    table = table.withColumn("chunk", F.col("slot")).repartition("chunk")
    for level in range(low, 0, -1):
        early, late, asks = _sides(level)
        table = table.withColumn("asks", early | (~late & asks)).withColumn("rank", _first_due("chunk", "slot", "asks"))
        table = table.withColumn("slot", _child(F.col("asks") & (F.col("rank") <= 1 << (level - 1))))
    return _round(table.select("s", "j", "r", "d", "slot"), path)[0]


def _sides(level: int) -> tuple[Column, Column, Column]:
    """Whether a block must run in the left half of its node, can't, or may ask to."""
    start, half = F.shiftleft("slot", level), 1 << (level - 1)
    return F.col("d") <= start + half, F.col("r") >= start + half, (F.col("r") < start) | _bit(level - 1)


def _child(left: Column) -> Column:
    return F.col("slot") * 2 + F.when(left, F.lit(0)).otherwise(F.lit(1))


def _round(table: DataFrame, old: str | None) -> tuple[DataFrame, str]:
    """``table`` written; the round before it is deleted."""
    out = written(table, "pfair-round")
    if old:
        discard(old)
    return out
