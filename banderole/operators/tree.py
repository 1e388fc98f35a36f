"""Reporting lines inside one filing: edges, depth, layers, spans, cycles, trees, verdicts.

Filings are independent, so every operator works on all (org, date) at once.  Chains have any length: pointers
double, so that after k rounds a post has seen 2**k posts above it, or summed 2**k generations below it.
Each round is one join and, for sums, one grouped pass over the posts still under way, is written and read again, and
replaces the round before; a chain of n posts takes log2(n) rounds.  Posts in a cycle, or below one, are those
whose number stands still between two rounds.

Two readings of a filing stay apart, as they are published: the *structure* (``resolved``, ``depths``, ``layers``,
``spans``) counts every live row and lets the last row of a repeated reference report; the *tree*
(``tree_nodes``, ``trees``) has one node a reference, the first row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import discard, written

FILING = ["org", "date"]
NODE = [*FILING, "pur"]


def _text(c: str):
    return F.coalesce(F.col(c), F.lit(""))


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the posts: its files are small, but every broadcast of it would pass through the driver, in every round."""
    return side.hint("merge")


def resolved(rows: DataFrame) -> DataFrame:
    """Live rows with ``parent`` resolved against all of the filing's rows, eliminated ones too.

    A row that reports to itself is a root; ``dangling`` has no reference or a parent outside the filing.
    """
    known = rows.where(_text("pur") != "").select(*FILING, F.col("pur").alias("p_pur")).distinct().alias("p")
    live = rows.where("status <> 'eliminated'").alias("c")
    on = (F.col("c.org") == F.col("p.org")) & (F.col("c.date") == F.col("p.date")) & (F.col("c.reports_to") == F.col("p_pur"))
    out = live.join(merged(known), on, "left").select("c.*", "p_pur")
    named = _text("pur") != ""
    has = (_text("reports_to") != "") & (_text("reports_to") != _text("pur"))
    return out.withColumns({"parent": F.when(named & has, F.col("p_pur")), "dangling": ~named | (has & F.col("p_pur").isNull()), "is_root": named & ~has}).drop("p_pur")


def parents(nodes: DataFrame) -> DataFrame:
    """(org, date, pur, parent, place): one row a reference, eliminated parents too.

    Of repeated references the last row that has a parent decides; ``place`` is the first row's.
    """
    own = nodes.where(_text("pur") != "").groupBy(*NODE).agg(F.max_by("parent", F.when(F.col("parent").isNotNull(), F.col("row_idx"))).alias("parent"), F.min("row_idx").cast("long").alias("place"))
    gone = nodes.where("parent is not null").select(*FILING, F.col("parent").alias("pur")).distinct().join(merged(own), NODE, "left_anti")
    return own.unionByName(gone.select(*NODE, F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("place")))


def _rounds(start: DataFrame, step, moving: str, most: int | None = None) -> tuple[DataFrame, int, str]:
    """Apply ``step(table, k)`` while fewer and fewer rows have ``moving``; (table, rows that never stop, path)."""
    table, path = written(start, "tree-round")
    before, k = None, 0
    while True:
        left = table.where(F.col(moving).isNotNull()).count()
        if not left or (left == before if most is None else k >= most):
            return table, left, path
        grown, next_path = written(step(table, k), "tree-round")
        discard(path)
        table, path, before, k = grown, next_path, left, k + 1


def _jump(table: DataFrame, columns: dict) -> DataFrame:
    """``table`` with ``up`` moved to where the row above points; ``columns`` may read the row above as ``above``."""
    above = table.select(*FILING, F.col("pur").alias("up"), F.struct(F.lit(True).alias("there"), *(F.col(c) for c in table.columns if c not in NODE)).alias("above"))
    joined = table.join(merged(above), [*FILING, "up"], "left")
    return joined.select(*NODE, *(columns[c].alias(c) if c in columns else F.col(c) for c in table.columns if c not in NODE))


def climb(edges: DataFrame) -> tuple[DataFrame, int]:
    """((org, date, pur, parent, place, depth, up), rows without a root above them) of one-row-a-reference edges.

    ``depth`` is 1 at posts that report to nobody; where ``up`` isn't null the post is in a cycle or below one.
    """
    start = edges.select(*NODE, "parent", "place", F.lit(1).cast("long").alias("depth"), F.col("parent").alias("up"))

    def step(t: DataFrame, k: int) -> DataFrame:
        deeper = F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.when(F.col("above.up").isNull(), F.lit(2**k) + F.col("above.depth")).otherwise(F.lit(2 ** (k + 1)) + 1))
        return _jump(t, {"up": F.col("above.up"), "depth": deeper})

    table, left, _ = _rounds(start, step, "up")
    return table, left


def cycles(nodes: DataFrame) -> DataFrame:
    """(org, date, pur, cycle, members): the posts that report to themselves through others; ``cycle`` is the
    member that is filed first, ``members`` their number."""
    table, left = climb(parents(nodes))
    return _cycles(table.where("up is not null"), left)


def _cycles(endless: DataFrame, left: int) -> DataFrame:
    """Of posts that climb without end those in the cycles themselves."""
    most = max(1, left.bit_length())
    begun = endless.select(*NODE, "parent", "place", F.col("parent").alias("up"))
    far, _, _ = _rounds(begun, lambda t, k: _jump(t, {"up": F.col("above.up")}), "up", most)
    # after as many steps as there are posts every pointer lies on a cycle, and each member has a pointer at it
    inside = far.select(*FILING, F.col("up").alias("pur")).distinct()
    first = F.struct(F.col("place").isNull().alias("gone"), "place", F.col("pur").alias("cycle"))
    ring = begun.join(merged(inside), NODE, "left_semi").select(*NODE, "up", first.alias("first"))
    lowest, _, _ = _rounds(ring, lambda t, k: _jump(t, {"up": F.col("above.up"), "first": F.least("first", "above.first")}), "up", most)
    named = lowest.select(*NODE, F.col("first.cycle").alias("cycle"))
    return named.join(merged(named.groupBy(*FILING, "cycle").agg(F.count("*").alias("members"))), [*FILING, "cycle"])


def depths(nodes: DataFrame) -> DataFrame:
    """(org, date, pur, depth) of every live post; those that report to nobody in the filing stand at 1.

    No post is dropped for a cycle: its first filed member stands at the number of members plus one, where a
    walk up from it has come round, and every other post in or below the cycle that much further.
    """
    edges = parents(nodes)
    table, left = climb(edges)
    out = table.where("up is null").select(*NODE, "place", F.col("depth"))
    if left:
        endless, _ = written(table.where("up is not null"), "tree-endless")
        ring, _ = written(_cycles(endless, left), "tree-cycles")
        cut = endless.join(merged(ring.where("pur = cycle").select(*NODE, F.lit(True).alias("cut"))), NODE, "left")
        again, _ = climb(cut.select(*NODE, F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), "place"))
        # every post below a cut takes the members of the cycle that it leads to
        head = cut.select(*NODE, F.when(F.col("cut"), F.col("pur")).alias("head"), F.when(F.col("cut").isNull(), F.col("parent")).alias("up"))
        led, _, _ = _rounds(head, lambda t, k: _jump(t, {"up": F.col("above.up"), "head": F.coalesce("head", "above.head")}), "up")
        sizes = ring.select(*FILING, F.col("cycle").alias("head"), "members").distinct()
        extra = led.join(merged(sizes), [*FILING, "head"]).select(*NODE, "members")
        out = out.unionByName(again.join(merged(extra), NODE).select(*NODE, "place", (F.col("depth") + F.col("members")).alias("depth")))
    return out.where("place is not null").select(*NODE, F.col("depth").cast("int").alias("depth"))


def layers(nodes: DataFrame, *by: str) -> DataFrame:
    """Live rows per depth (and ``by``, as grades); rows of a repeated reference each count."""
    placed = nodes.where(_text("pur") != "").join(merged(depths(nodes)), NODE)
    return placed.groupBy(*FILING, "depth", *by).agg(F.count("*").alias("posts"))


def spans(nodes: DataFrame) -> DataFrame:
    """Per filing: posts, parents, leaves, widest span, upper median span and mean span."""
    reports = nodes.where("parent is not null").groupBy(*FILING, "parent").agg(F.count("*").alias("reports"))
    sizes = nodes.groupBy(*FILING).agg(F.count("*").alias("posts"), F.count_if("dangling").alias("dangling"), F.count_if("is_root").alias("roots"))
    # spans as a histogram: as many rows as there are different spans, not managers
    widths = reports.groupBy(*FILING, "reports").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*FILING).orderBy("reports"))
    middle = widths.withColumns({"upto": upto, "all": F.sum("n").over(W.partitionBy(*FILING))}).where(F.col("upto") > F.floor(F.col("all") / 2))
    per = widths.groupBy(*FILING).agg(F.sum("n").alias("parents"), F.max("reports").alias("widest"), F.sum(F.col("reports") * F.col("n")).alias("reporting"))
    per = per.join(middle.groupBy(*FILING).agg(F.min("reports").alias("median_span")), FILING)
    out = sizes.join(per, FILING, "left").na.fill(0, ["parents", "widest", "reporting"])
    return out.withColumns({"leaves": F.col("posts") - F.col("parents"), "mean_span": F.try_divide("reporting", "parents")})


def verdicts(stats: DataFrame, *, least: int = 30, most_roots: int = 2, most_alone: int = 3) -> DataFrame:
    """Whether a filing's structure can be shown, and the first reason why not."""
    reason = (
        F.when(F.col("posts") == 0, "no posts")
        .when(F.col("posts") < least, "fewer than 30 posts")
        .when(F.col("dangling") > 0, "dangling reports")
        .when(F.col("roots") > most_roots, "too many roots")
        .when(F.col("reporting") < F.col("posts") - most_alone, "incomplete")
    )
    return stats.withColumns({"reason": reason, "kept": reason.isNull()})


def tree_nodes(rows: DataFrame) -> DataFrame:
    """One node a reference, the first live row's, with ``parent``, ``outside`` and the filing's repeats left out.

    A parent that is eliminated makes a root, so does a reference outside the filing (``outside``) or to itself.
    """
    live = rows.where("status <> 'eliminated'")
    named = live.where(_text("pur") != "")
    kept = [c for c in rows.columns if c not in NODE]
    first = named.groupBy(*NODE).agg(F.min_by(F.struct(*kept), "row_idx").alias("row")).select(*NODE, "row.*")
    grades = live.groupBy(*FILING, "grade").agg(F.min("row_idx").alias("grade_place"))
    known = rows.where(_text("pur") != "").groupBy(*NODE).agg(F.bool_or(F.coalesce(F.col("status"), F.lit("")) != "eliminated").alias("lives")).withColumnRenamed("pur", "reports_to")
    has = (_text("reports_to") != "") & (_text("reports_to") != F.col("pur"))
    out = first.join(merged(known), [*FILING, "reports_to"], "left")
    out = out.alias("n").join(merged(grades.alias("g")), (F.col("n.org") == F.col("g.org")) & (F.col("n.date") == F.col("g.date")) & F.col("n.grade").eqNullSafe(F.col("g.grade")), "left").select("n.*", "grade_place")
    return out.withColumns({"parent": F.when(has & F.col("lives"), F.col("reports_to")), "outside": has & F.col("lives").isNull()}).drop("lives")


def trees(nodes: DataFrame) -> DataFrame:
    """Nodes that a root leads to, with depth, size and height of their subtree, the sum of its disclosed floors,
    and their place among their siblings (grades in the order in which they are filed, larger subtrees, titles).

    Nodes in or below a cycle have no root above them and are left out; ``tree_totals`` counts them.
    """
    place = nodes.withColumn("place", F.col("row_idx").cast("long"))
    found, _ = climb(place.select(*NODE, "parent", "place"))
    depth = found.where("up is null").select(*NODE, "depth")
    pay = F.when(F.col("disclosed"), F.coalesce("floor", F.lit(0))).otherwise(0).cast("long")
    start = nodes.join(merged(depth), NODE).select(*NODE, F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("height"), pay.alias("subtree_floor"))
    sums, _, _ = _rounds(start, _gather, "up")
    whole = nodes.drop("floor").join(merged(depth), NODE).join(merged(sums.drop("up")), NODE)
    among = W.partitionBy(*FILING, "parent")
    kids = among.orderBy("grade_place", F.desc("size"), "title", "pur")
    roots = among.orderBy(F.desc("size"), "grade_place", "row_idx")
    rank = F.when(F.col("parent").isNull(), F.row_number().over(roots)).otherwise(F.row_number().over(kids))
    return whole.select(*NODE, "parent", F.col("depth").cast("int").alias("depth"), "size", F.col("height").cast("int").alias("height"), "subtree_floor", rank.alias("sibling"))


def _gather(table: DataFrame, k: int) -> DataFrame:
    """Every node adds up what the nodes 2**k below it have gathered, and its pointer doubles."""
    below = table.where("up is not null").groupBy(*FILING, F.col("up").alias("pur")).agg(F.sum("size").alias("s"), F.max("height").alias("h"), F.sum("subtree_floor").alias("f"))
    grown = table.join(merged(below), NODE, "left").select(
        *NODE, "up", (F.col("size") + F.coalesce("s", F.lit(0))).alias("size"), F.greatest("height", F.col("h") + 2**k).alias("height"), (F.col("subtree_floor") + F.coalesce("f", F.lit(0))).alias("subtree_floor")
    )
    above = table.select(*FILING, F.col("pur").alias("up"), F.col("up").alias("next"))
    return grown.join(merged(above), [*FILING, "up"], "left").select(*NODE, F.col("next").alias("up"), "size", "height", "subtree_floor")


def tree_totals(rows: DataFrame) -> DataFrame:
    """Per filing: nodes that a root leads to, roots, orphans (rows without a reference, repeats, parents outside) and nodes in or below cycles."""
    nodes = tree_nodes(rows)
    found, _ = climb(nodes.select(*NODE, "parent", F.col("row_idx").cast("long").alias("place")))
    live = rows.where("status <> 'eliminated'").groupBy(*FILING).agg(F.count("*").alias("live"))
    per = nodes.groupBy(*FILING).agg(F.count("*").alias("named"), F.count_if("outside").alias("outside"))
    led = found.groupBy(*FILING).agg(F.count_if(F.col("up").isNull()).alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"), F.count_if(F.col("up").isNotNull()).alias("endless"))
    out = live.join(per, FILING, "left").join(led, FILING, "left").na.fill(0)
    return out.select(*FILING, "nodes", "roots", (F.col("live") - F.col("named") + F.col("outside")).alias("orphans"), "endless")


def reveal(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """Nodes to show so that every match is seen: the matches and all above them, where a root leads to them."""
    found, _ = climb(nodes.select(*NODE, "parent", F.col("row_idx").cast("long").alias("place")))
    hit = matched.select(*NODE).distinct().withColumn("hit", F.lit(1))
    start = found.where("up is null").join(merged(hit), NODE, "left").select(*NODE, F.col("parent").alias("up"), F.coalesce("hit", F.lit(0)).alias("hits"))

    def step(t: DataFrame, k: int) -> DataFrame:
        below = t.where("up is not null").groupBy(*FILING, F.col("up").alias("pur")).agg(F.max("hits").alias("h"))
        grown = t.join(merged(below), NODE, "left").select(*NODE, "up", F.greatest("hits", "h").alias("hits"))
        above = t.select(*FILING, F.col("pur").alias("up"), F.col("up").alias("next"))
        return grown.join(merged(above), [*FILING, "up"], "left").select(*NODE, F.col("next").alias("up"), "hits")

    seen, _, _ = _rounds(start, step, "up")
    return seen.where("hits > 0").select(*NODE)
