"""Reference dates, periods and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as files write them.
MONTHS = {
    **{m: k for k, m in enumerate("january february march april may june july august september october november december".split(), 1)},
    **{m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)},
    "sept": 9,
}
_LONGEST_FIRST = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
MONTH_YEAR = f"(?i)({_LONGEST_FIRST})[^0-9a-z]{{0,4}}[0-9]*?(20[0-9]{{2}})(?![0-9])"
STAMP = "[tT][0-9:.-]{4,}"


def decoded(url: Column) -> Column:
    return F.coalesce(F.try_url_decode(url), url, F.lit(""))


def make_date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where no such day exists."""
    return F.try_to_date(F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))), "yyyy-MM-dd")


def quarter_end(year: Column, month: Column) -> Column:
    return F.last_day(F.make_date(year, F.ceil(month / 3).cast("int") * 3, F.lit(1)))


def preceding_quarter_end(d: Column) -> Column:
    """The latest quarter end on or before a date."""
    own = quarter_end(F.year(d), F.month(d))
    return F.when(own <= d, own).otherwise(F.date_sub(F.trunc(d, "quarter"), 1))


def _parts(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    return make_date(*(F.regexp_extract(text, pattern, k) for k in order))


def upload_date(url: Column) -> Column:
    return _parts(decoded(url), f"(20[0-9]{{2}})-([0-9]{{2}})-([0-9]{{2}}){STAMP}", (1, 2, 3))


def declared_date(url: Column) -> Column:
    """A reference date in the resource's path, by the first form that is there."""
    u = decoded(url)
    return F.coalesce(
        _parts(u, "(?i)([0-9]{4})-([0-9]{2})-([0-9]{2})-organogram", (1, 2, 3)),
        _parts(u, "/organogram/[^/]+/([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})/", (3, 2, 1)),
        _parts(u, "([0-9]{1,2})-([0-9]{1,2})-(20[0-9]{2})(?![0-9])", (3, 2, 1)),
        _parts(u, f"(20[0-9]{{2}})-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(?!{STAMP})", (1, 2, 3)),
    )


def month_year_quarter_end(text: Column) -> Column:
    """The end of the quarter of a month and year named in the text."""
    t = F.coalesce(text, F.lit(""))
    name, year = F.lower(F.regexp_extract(t, MONTH_YEAR, 1)), F.regexp_extract(t, MONTH_YEAR, 2)
    months = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    return F.when(name != "", quarter_end(year.try_cast("int"), F.try_element_at(months, name)))


def reference_date(url: Column, package: Column, title: Column, uploaded: Column, resource: Column) -> Column:
    """struct(date, confidence, basis) by the first source that dates the file."""
    found = [
        (declared_date(url), "declared", "url"),
        (month_year_quarter_end(decoded(url)), "inferred", "url-month"),
        (month_year_quarter_end(resource), "inferred", "resource-name"),
        (month_year_quarter_end(package), "inferred", "package-name"),
        (month_year_quarter_end(title), "inferred", "package-title"),
        (preceding_quarter_end(F.coalesce(upload_date(url), F.try_to_date(F.substring(uploaded, 1, 10), "yyyy-MM-dd"))), "default", "upload-stamp"),
    ]
    made = [F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(c).alias("confidence"), F.lit(b).alias("basis"))) for d, c, b in found]
    none = F.struct(F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("confidence"), F.lit("none").alias("basis"))
    return F.coalesce(*made, none)


def period(d: Column, grain: str) -> Column:
    """struct(key, label, end, year) of a date at grain date, quarter, half or year."""
    y, m = F.year(d), F.month(d)
    if grain == "date":
        key = label = d.cast("string")
        end = d
    elif grain == "year":
        key = label = y.cast("string")
        end = F.make_date(y, F.lit(12), F.lit(31))
    else:
        months, letter = {"half": (6, "H"), "quarter": (3, "Q")}[grain]
        k = F.ceil(m / months).cast("int")
        key, label = F.concat(y, F.lit(f"-{letter}"), k), F.concat(y, F.lit(f" {letter}"), k)
        end = F.last_day(F.make_date(y, k * months, F.lit(1)))
    return F.struct(key.alias("key"), label.alias("label"), end.alias("end"), y.alias("year"))


def archive_time(stamp: Column) -> Column:
    """A 4- to 14-digit archive stamp as a timestamp; missing digits are zeros (months and days ones)."""
    full = F.concat(stamp, F.substring(F.lit("00000101000000"), F.length(stamp) + 1, F.lit(14)))
    return F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss"))


def months_since(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / 30.44


def years_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / 365.2425


def live_at(valid_from: Column, valid_to: Column, d: Column) -> Column:
    """Whether a closed interval with open ends holds a date."""
    return (valid_from.isNull() | (valid_from <= d)) & (valid_to.isNull() | (d <= valid_to))


def date_label(d: Column) -> Column:
    return F.date_format(d, "d MMMM yyyy")
