"""Facts about the whole corpus, captures of archived files, claims on organisations, earner rolls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..schema import THIN


# --- facts ----------------------------------------------------------------------------------------
def stats(cube: DataFrame) -> DataFrame:
    """One row: organisations, snapshots, dates, cells and people of a cube; the rate to three places."""
    snap = F.struct("org", "date")
    sums = {m: F.sum(m).cast("long") for m in ("n", "withheld", "vacant", "eliminated", "open_band")}
    one = cube.agg(
        F.countDistinct("org").alias("orgs"), F.countDistinct(snap).alias("snapshots"), F.countDistinct("date").alias("dates"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("cells"), *(v.alias(k) for k, v in sums.items()),
    )
    here = F.col("n") + F.col("withheld")
    rate = F.when(here > 0, F.floor(F.col("n") * 1000 / here + 0.5) / 1000).otherwise(0.0)
    return one.withColumns({"posts": here + F.col("eliminated"), "headcount": here, "disclosure_rate": rate}).withColumnRenamed("n", "disclosed")


def share_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """(period, share): the part of each period's headcount in some groups; null where there is none."""
    inside = F.sum(F.when(F.col("group_key").isin(*keys), F.col("headcount")).otherwise(0))
    return df.groupBy("period").agg(F.try_divide(inside, F.sum("headcount")).alias("share"))


def populated(df: DataFrame) -> DataFrame:
    """(group_key, first_period, last_period, latest): periods with anyone in them, and the last headcount."""
    some = df.where(F.col("headcount") > 0)
    return some.groupBy("group_key").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.max_by("headcount", "period").alias("latest"))


def rate_extremes(df: DataFrame, rate: str, least: int = THIN) -> DataFrame:
    """One row: the groups with the lowest and the highest rate in the last period that has anyone.

    Groups below ``least`` people or without a rate don't count; of equal rates the smaller key is the
    lowest and the larger one the highest.  With fewer than two groups all four columns are null.
    """
    some = df.where(F.col("headcount") > 0)
    last = some.agg(F.max("period").alias("last_period"))
    rows = some.join(last, F.col("period") == F.col("last_period")).where((F.col("headcount") >= least) & F.col(rate).isNotNull())
    pair = F.struct(F.col(rate).alias("rate"), F.col("group_key").alias("key"))
    ends = rows.agg(F.count(F.lit(1)).alias("groups"), F.min(pair).alias("low"), F.max(pair).alias("high"))
    fields = {f"{end}_{x}": F.col(f"{end}.{y}") for end in ("low", "high") for x, y in (("group", "key"), ("rate", "rate"))}
    return ends.select("groups", *(F.when(F.col("groups") >= 2, c).alias(name) for name, c in fields.items()))


def against_previous(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``before`` and ``change``: a group's value in the period before that it filed in."""
    w = Window.partitionBy("group_key").orderBy("period")
    return df.withColumn("before", F.lag(column).over(w)).withColumn("change", F.col(column) - F.col("before"))


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(value, place): the distinct values, by their place in the given order, others after it by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("value")).cast("int")
    return df.select(F.col(column).alias("value")).distinct().withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1))


def dictionary_loss(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(dictionary, value): what a new build no longer knows; one distinct pass a build."""
    values = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dictionary"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").where("value is not null").distinct()
    return values(before).join(values(after), ["dictionary", "value"], "left_anti")


def rate_moves(before: DataFrame, after: DataFrame, by: list[str], limit: float) -> DataFrame:
    """Disclosure rates that moved by ``limit`` or more between two builds."""
    rate = lambda df, name: df.groupBy(*by).agg(F.try_divide(F.sum("n"), F.sum(F.col("n") + F.col("withheld"))).alias(name))
    both = rate(before, "was").join(rate(after, "is"), by)
    return both.withColumn("moved", F.col("is") - F.col("was")).where(F.abs("moved") >= limit)


# --- organisations --------------------------------------------------------------------------------
def live_between(orgs: DataFrame, first: str, last: str) -> DataFrame:
    """Organisations that exist at both ends."""
    alive = lambda d: dates.live_at(F.col("valid_from"), F.col("valid_to"), F.lit(d).cast("date"))
    return orgs.where(alive(first) & alive(last))


def claimed(resources: DataFrame, claims: DataFrame, disowned: DataFrame) -> DataFrame:
    """Each resource with the organisations that claim its package and ``out_of_window``.

    A package with several claims goes to those whose validity holds the resource's date; a package
    with one claim stays with it, and is said to be out of its window.  Disowned pairs of package and
    organisation are no claims.  The claims are a curated list, joined by package.
    """
    own = claims.join(disowned.select("pkg", "org"), ["pkg", "org"], "left_anti")
    shared = own.groupBy("pkg").agg((F.count("*") > 1).alias("shared"))
    out = resources.join(own, "pkg").join(shared, "pkg")
    inside = dates.live_at(F.col("valid_from"), F.col("valid_to"), F.col("date"))
    return out.where(~F.col("shared") | inside).withColumn("out_of_window", ~inside).drop("valid_from", "valid_to", "shared")


# --- archived captures ----------------------------------------------------------------------------
STAMP = "^[0-9]{8,14}$"


def capture_rows(body: Column) -> Column:
    """array<map> of an index answer: an array of arrays with a header first, or one JSON object a line."""
    table = F.from_json(body, "array<array<string>>")
    named = F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), lambda r: F.map_from_arrays(F.element_at(table, 1), r))
    lines = F.transform(F.filter(F.split(F.trim(body), "\\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, "map<string,string>"))
    return F.when(F.trim(body).startswith("[["), named).otherwise(lines)


def pick_capture(captures: DataFrame, by: str, near: Column | None = None) -> DataFrame:
    """Per ``by`` the earliest usable capture, or the one nearest to ``near``, the earlier of two.

    ``captures``: (by, timestamp, status, mime); usable: status 200, no page, a valid stamp.  A grouped
    minimum, so a file with any number of captures is combined map-side.
    """
    good = captures.where((F.col("status") == "200") & ~F.coalesce(F.col("mime"), F.lit("")).rlike("(?i)text/html|application/xhtml") & F.col("timestamp").rlike(STAMP))
    gap = F.lit(0) if near is None else F.coalesce(F.abs(F.unix_timestamp(dates.archive_time(F.col("timestamp"))) - F.unix_timestamp(dates.archive_time(near))), F.lit(0))
    rank = F.struct(gap.alias("gap"), F.col("timestamp").alias("timestamp"), F.col("mime").alias("mime"))
    return good.groupBy(by).agg(F.min(rank).alias("pick")).select(by, "pick.timestamp", "pick.mime")


def pick_redirect(captures: DataFrame, by: str) -> DataFrame:
    """Per ``by`` the earliest capture that is a redirect."""
    return captures.where(F.col("status").rlike("^3[0-9][0-9]$") & F.col("timestamp").rlike(STAMP)).groupBy(by).agg(F.min(F.struct("timestamp", "status")).alias("pick")).select(by, "pick.timestamp", "pick.status")


# --- rolls ----------------------------------------------------------------------------------------
def roll(rows: DataFrame, words: list[str], *, over: list[str], year: int | None = None, civil_only: bool = False) -> DataFrame:
    """Rows of a year whose text over some columns holds every word."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in over)))
    tests = [F.contains(hay, F.lit(w.lower())) for w in words if w]
    tests += [F.col("year") == year] if year is not None else []
    tests += [F.col("civil")] if civil_only else []
    return rows.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """A page of an ordered table: top-k over pages 0 to ``number``, then its last ``size`` rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


# --- cells ----------------------------------------------------------------------------------------
def strict_money(c: Column) -> Column:
    """Whole pounds of a cell that is an amount and nothing else; zero says nothing."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[£,\\s]", "")
    value = F.floor(F.regexp_extract(digits, "^[0-9]+(\\.[0-9]+)?$", 0).try_cast("double") + 0.5).cast("long")
    return F.when(value > 0, value)


def strict_count(c: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[,\\s]", "")
    return F.regexp_extract(digits, "^[0-9]+$", 0).try_cast("long")


def split_key(key: Column) -> Column:
    """struct(base, tier) of "base|A"; other keys have no tier."""
    tier = F.regexp_extract(key, "^.+\\|([AB])$", 1)
    return F.struct(F.when(tier != "", F.regexp_extract(key, "^(.+)\\|[AB]$", 1)).otherwise(key).alias("base"), F.when(tier != "", tier).alias("tier"))


def column_index(letters: Column) -> Column:
    """The number of a spreadsheet column: A is 1, AA is 27."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda n, ch: F.when(ch == "", n).otherwise(n * 26 + F.ascii(ch) - 64))
