"""Regression gates between builds, audits and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The gates' limits.
POSTS_FAIL, POSTS_WARN = -0.05, -0.01
ORG_FAIL, ORG_WARN = -0.10, -0.02
MEDIAN_MOVE, MEDIAN_N = 0.10, 50
BYTES_MOVE = 0.25
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


def change(before: Column, now: Column) -> Column:
    return F.try_divide(now - before, before)


def org_gates(before: DataFrame, now: DataFrame) -> DataFrame:
    """(org, level, gate, before, now, change) for organisations that vanished or shrank."""
    b, n = before.select("org", F.col("posts").alias("before")), now.select("org", F.col("posts").alias("now"))
    both = b.join(n, "org", "full_outer").withColumn("change", change(F.col("before"), F.col("now")))
    gone = F.col("now").isNull()
    level = F.when(gone | (F.col("change") <= ORG_FAIL), "fail").when(F.col("change") <= ORG_WARN, "warn")
    return both.withColumn("level", level).where("level is not null").withColumn("gate", F.when(gone, "org-vanished").otherwise("org-posts"))


def total_gates(before: DataFrame, now: DataFrame) -> DataFrame:
    """One row per tripped gate over whole builds (columns snapshots, posts, failures, files, undated)."""
    b, n = (df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("snapshots", "posts", "failures", "files", "undated"))) for df, p in ((before, "b"), (now, "n")))
    row = b.crossJoin(F.broadcast(n))  # one row each
    posts = change(F.col("b_posts"), F.col("n_posts"))
    rate = lambda p: F.coalesce(F.try_divide(F.col(f"{p}_failures"), F.col(f"{p}_files")), F.lit(0.0))
    gates = {
        "snapshots": F.when(F.col("n_snapshots") < F.col("b_snapshots"), "fail"),
        "posts": F.when(posts <= POSTS_FAIL, "fail").when(posts <= POSTS_WARN, "warn"),
        "failures": F.when(F.col("n_failures") - F.col("b_failures") >= 5, "warn"),
        "failure-rate": F.when(rate("n") - rate("b") >= 0.02, "fail"),
        "undated": F.when(F.col("n_undated") - F.col("b_undated") >= 10, "warn"),
    }
    made = F.array(*(F.struct(F.lit(g).alias("gate"), level.alias("level")) for g, level in gates.items()))
    return row.select(F.inline(F.filter(made, lambda x: x["level"].isNotNull())))


def median_gates(before: DataFrame, now: DataFrame) -> DataFrame:
    """Dates whose joint median band moved by over a tenth, with enough posts in both builds."""
    n = now.select("date", F.col("n").alias("n2"), F.col("bin_low").alias("bin_low2"))
    moved = F.abs(change(F.col("bin_low"), F.col("bin_low2")))
    return before.join(n, "date").where((F.col("n") >= MEDIAN_N) & (F.col("n2") >= MEDIAN_N)).withColumn("moved", moved).where(F.col("moved") > MEDIAN_MOVE)


def missing_from(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Values that the earlier build has and the later lacks."""
    return before.select(key).distinct().join(now.select(key), key, "left_anti")


def two_way(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, side): new and withdrawn values."""
    new = missing_from(now, before, key).withColumn("side", F.lit("new"))
    return new.unionByName(missing_from(before, now, key).withColumn("side", F.lit("withdrawn")))


def floors(df: DataFrame, least: dict[str, int]) -> None:
    """Raise if a one-row summary falls below a floor."""
    row = df.select(*least).first()
    low = [f"{c} {row[c]} < {n}" for c, n in least.items() if row[c] is None or row[c] < n]
    if low:
        raise ValueError("below the floor: " + ", ".join(low))


def emails(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n): rows that leak e-mail addresses."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(EMAIL), F.lit(0))
    return df.where(F.contains(F.coalesce(F.col(text), F.lit("")), F.lit("@"))).select(key, F.size(found).cast("long").alias("n")).where("n > 0")


def bigrams(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def name_leaks(payload: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pair): word pairs of a text that are a person's name."""
    pairs = payload.select(key, F.explode(F.array_distinct(bigrams(F.col(text)))).alias("pair"))
    forbidden = names.select(F.explode(bigrams(F.col("name"))).alias("pair")).distinct()
    return pairs.join(forbidden, "pair", "left_semi").select(key, "pair")


def digest(df: DataFrame, *leave_out: str) -> DataFrame:
    """One row: an order-free content digest that ignores the columns left out."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns if c not in leave_out]
    h = F.xxhash64(*cols)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_000_007))), F.lit(0)).alias("sum"))


def joint_medians(cube: DataFrame) -> DataFrame:
    """Per date the weighted joint median band: the first cell by (low, high) that reaches half."""
    from pyspark.sql import Window

    cells = cube.where("bin_low >= 0").groupBy("date", "bin_low", "bin_high").agg(F.sum("n").cast("long").alias("w"))
    w = Window.partitionBy("date")
    run = cells.withColumns({"cum": F.sum("w").over(w.orderBy("bin_low", "bin_high")), "n": F.sum("w").over(w)})
    first = F.min(F.struct("bin_low", "bin_high"))
    return run.where(F.col("cum") >= F.col("n") / 2).groupBy("date", "n").agg(first.alias("m")).select("date", "n", "m.bin_low", "m.bin_high")


def identity_survey(posts: DataFrame) -> DataFrame:
    """(kind, rows): full band, open band, withheld and eliminated posts, and their sum."""
    gone = F.col("status") == "eliminated"
    kind = F.when(gone, "eliminated").when(F.col("bin_low") >= 0, "banded").when(F.col("bin_low") == -2, "open").otherwise("withheld")
    return posts.rollup(kind.alias("kind")).agg(F.count("*").alias("rows")).na.fill("all", ["kind"])
