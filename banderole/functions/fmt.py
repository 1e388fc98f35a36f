"""Display of figures: bands stay bands, aggregates round outwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _or_dash(c: Column, text: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c.cast("double")), DASH).otherwise(text)


def _whole(c: Column) -> Column:
    return F.format_number(F.floor(c + 0.5).cast("long"), 0)


def gbp(c: Column) -> Column:
    return _or_dash(c, F.concat(F.lit("£"), _whole(c)))


def gbp_compact(c: Column) -> Column:
    """£12.3bn, £12m, £45k."""
    a = F.abs(c)
    scaled = lambda by, suffix: F.concat(F.lit("£"), F.when(a >= by * 10, F.format_string("%.0f", c / by)).otherwise(F.format_string("%.1f", c / by)), F.lit(suffix))
    plain = lambda by, suffix: F.concat(F.lit("£"), F.floor(c / by + 0.5).cast("long").cast("string"), F.lit(suffix))
    return _or_dash(c, F.when(a >= 1e9, scaled(1e9, "bn")).when(a >= 1e6, scaled(1e6, "m")).when(a >= 1e3, plain(1e3, "k")).otherwise(plain(1, "")))


def gbp_rounded(c: Column) -> Column:
    return _or_dash(c, F.concat(F.lit("£"), _whole(F.floor(c / 1000 + 0.5) * 1000)))


def num(c: Column, dp: int = 0) -> Column:
    return _or_dash(c, F.format_number(c.cast("double"), dp))


def pct(c: Column, dp: int = 1, sign: bool = True, of: Column | None = None) -> Column:
    """With ``sign`` a plus where ``of``, the value itself unless another is given, isn't negative."""
    return _or_dash(c, F.concat(F.when((c if of is None else of) >= 0, "+" if sign else "").otherwise(""), F.format_string(f"%.{dp}f%%", c.cast("double"))))


def share(c: Column, dp: int = 1) -> Column:
    return _or_dash(c, F.format_string(f"%.{dp}f%%", c.cast("double") * 100))


def band(lo: Column, hi: Column, each=gbp) -> Column:
    """Both ends, or the one there is; equal ends collapse."""
    one = each(F.coalesce(lo, hi))
    return F.when(lo.isNull() | hi.isNull() | (lo == hi), one).otherwise(F.concat(each(lo), F.lit("–"), each(hi)))


def pct_band(a: Column, b: Column, dp: int = 0) -> Column:
    """A change as the range its bounds allow; ends less than half a point apart collapse."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    same = (pct(lo, dp) == pct(hi, dp)) | (hi - lo < 0.5)
    return F.when(a.isNull() | b.isNull(), pct(F.coalesce(a, b), dp)).when(same, pct((lo + hi) / 2, dp)).otherwise(F.concat(pct(lo, dp), F.lit(" to "), pct(hi, dp)))


def step(c: Column) -> Column:
    """Three significant figures, a thousand at least."""
    a = F.abs(c).cast("double")
    return F.when(a > 0, F.greatest(F.lit(1000.0), F.pow(F.lit(10.0), F.floor(F.log10(a)) - 2))).otherwise(1000.0)


def rounded_band(lo: Column, hi: Column) -> Column:
    """A range rounded outwards, so that it always contains the true one."""
    by = step(F.greatest(F.abs(lo), F.abs(hi)))
    l, u = F.floor(lo / by) * by, F.ceil(hi / by) * by
    return F.when(lo.isNull() | hi.isNull(), DASH).when(l == u, gbp(l)).otherwise(F.concat(gbp(l), F.lit("–"), gbp(u)))


def rounded_figure(c: Column) -> Column:
    by = step(c)
    return _or_dash(c, gbp(F.floor(c / by + 0.5) * by))


def count_range(certain: Column, possible: Column) -> Column:
    return F.when(certain.isNull() | possible.isNull(), DASH).when(certain == possible, num(certain)).otherwise(F.concat(num(certain), F.lit("–"), num(possible)))


# What each measure is called.
LABELS = {
    "medianPay": "Median pay band", "meanPay": "Mean pay", "p10": "Lowest decile", "p25": "Lower quartile", "p75": "Upper quartile", "p90": "Top decile", "paybill": "Senior pay bill", "headcount": "Senior posts",
    "fte": "Senior FTE", "disclosureRate": "Disclosure rate", "disclosed": "Posts with a published band", "withheld": "Posts with pay withheld", "vacant": "Vacant posts", "eliminated": "Eliminated posts",
    "openBand": "Posts with one band edge only", "posts": "Published post rows", "fteKnownRate": "Share with a published FTE", "medianPost": "Median pay band", "meanPost": "Mean pay", "meanFTE": "Mean pay per FTE",
}
SHARES = ("disclosureRate", "fteKnownRate")
COUNTS = ("headcount", "disclosed", "withheld", "vacant", "eliminated", "openBand", "posts")
MEANS = ("meanPay", "meanPost", "meanFTE")


def measure_label(measure: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, measure), measure)


def measure_unit(measure: Column) -> Column:
    """The line under a figure."""
    return (
        F.when(measure.isin(*SHARES), "share of published senior posts").when(measure.isin("headcount", "posts"), "published senior posts").when(measure == "fte", "full-time equivalent")
        .when(measure == "paybill", "£ per year, base pay, FTE-weighted").when(measure.isin(*COUNTS), "posts").otherwise("£ per year, base pay")
    )


def measure_text(measure: Column, value: Column) -> Column:
    """A value as its measure prints: shares, counts, compact bills, rounded means, else pounds."""
    return F.when(measure.isin(*SHARES), share(value)).when(measure == "fte", num(value, 1)).when(measure.isin(*COUNTS), num(value)).when(measure == "paybill", gbp_compact(value)).when(measure.isin(*MEANS), gbp_rounded(value)).otherwise(gbp(value))
