"""Conservative joins: unique on both sides, keys chosen by match rate, siblings deduplicated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NON_KEY = "(?i)^(|-+|xx+|n[/ ]?a|n[/ ]?d|none|tbc|vacant|unknown|not disclosed)$"
PLACEHOLDER = "(?i)^(0+|deleted|vacant|tbc)?$"


def key_of(*parts: Column) -> Column:
    """A composite key; null if any part is blank or a non-answer."""
    norm = [F.trim(F.regexp_replace(F.lower(F.coalesce(p.cast("string"), F.lit(""))), "[^a-z0-9]+", " ")) for p in parts]
    ok = reduce(lambda a, b: a & b, [~n.rlike(NON_KEY) for n in norm])
    return F.when(ok, F.concat_ws("|", *norm))


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't null and occurs once; counted by a grouped pass, so a key that is
    repeated many times never meets in one window."""
    once = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    return df.join(once, key, "left_semi")


def match_rates(left: DataFrame, right: DataFrame, candidates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(candidate, place, matched, keyed, rate): how many of the left's rows each key would match."""
    out = []
    for place, (name, (lk, rk)) in enumerate(candidates.items()):
        l, r = left.select(lk.alias("k")), right.select(rk.alias("k"))
        hit = unique_by(l, "k").join(unique_by(r, "k"), "k", "left_semi")
        n = left.agg(F.count("*").alias("rows"))
        out.append(hit.agg(F.count("*").alias("matched")).crossJoin(n).select(F.lit(name).alias("candidate"), F.lit(place).alias("place"), "matched", "rows"))
    return reduce(DataFrame.unionByName, out).withColumn("rate", F.coalesce(F.try_divide("matched", "rows"), F.lit(0.0)))


def choose_key(rates: list, margin: float = 0.1) -> str:
    """The first candidate, unless a later one beats it by more than the margin."""
    best = None
    for r in sorted(rates, key=lambda r: r["place"]):
        if best is None or r["rate"] > best["rate"] + margin:
            best = r
        if best["rate"] >= 1:
            break
    return best["candidate"]


def two_file_join(posts: DataFrame, pay: DataFrame, on: tuple[Column, Column], columns: list[str]) -> DataFrame:
    """Every post, with the missing pay columns where its key is unique on both sides."""
    l = posts.withColumn("_k", on[0])
    once = unique_by(l.select("_k"), "_k")
    r = unique_by(pay.withColumn("_k", on[1]), "_k").join(once, "_k", "left_semi").select("_k", *columns, F.lit(True).alias("matched"))
    return l.join(r, "_k", "left").withColumn("matched", F.coalesce("matched", F.lit(False))).drop("_k")


def dedupe_siblings(rows: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Across the parts (pkg) of a snapshot (org, date), the first of each reference stays, the
    largest part first, ties by name; placeholders never match, and single parts are left alone,
    repeats and all."""
    sizes = parts if parts is not None else rows.groupBy("org", "date", "pkg").agg(F.count("*").alias("part_rows"))
    many = Window.partitionBy("org", "date")
    sized = sizes.withColumn("n_parts", F.count("*").over(many))
    joined = rows.join(sized, ["org", "date", "pkg"])
    w = Window.partitionBy("org", "date", "pur").orderBy(F.desc("part_rows"), "pkg", "row_idx")
    real = ~F.coalesce(F.col("pur").cast("string"), F.lit("")).rlike(PLACEHOLDER)
    return joined.withColumn("place", F.row_number().over(w)).where((F.col("n_parts") < 2) | ~real | (F.col("place") == 1)).drop("place", "n_parts", "part_rows")


def ordinals(rows: DataFrame, file: str = "file") -> DataFrame:
    """0-based repeat number of a reference in its file; 0 without one."""
    w = Window.partitionBy(file, "pur").orderBy("row_idx")
    return rows.withColumn("ordinal", F.when(F.col("pur") != "", F.row_number().over(w) - 1).otherwise(0).cast("int"))


def resource_winner(resources: DataFrame) -> DataFrame:
    """Of the parsed resources of a package and date the latest created wins."""
    w = Window.partitionBy("pkg", "date").orderBy(F.desc("created"), F.desc("url"))
    return resources.where("parsed").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def crosswalk(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Each asked key's best row: equal code, equal role, prefix either way, equal market title.

    The table is a curated list of some hundred rows, broadcast for the ranked predicates.
    """
    a, t = F.col("asked"), F.broadcast(table)
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "[^a-z0-9]+", " "))
    role, market = norm(F.col("role")), norm(F.col("market_title"))
    q = norm(a)
    rank = F.when(a == F.col("soc"), 1).when(q == role, 2).when((q != "") & (role.startswith(q) | q.startswith(role)), 3).when(q == market, 4)
    hits = asked.join(t, rank.isNotNull()).withColumn("rank", rank)
    w = Window.partitionBy("asked").orderBy("rank", "soc")
    return hits.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
