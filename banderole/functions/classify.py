"""Classification of published fields: status, grade, profession, flags, money, bands.

Every rule list becomes one CASE expression inside the plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BAND_OPEN, BAND_WITHHELD, BIN, SENIOR_GRADES

SPACE = "[\\s\\u00a0\\ufeff]"


def clean(c: Column) -> Column:
    """Trimmed of all Unicode space; null becomes empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), f"^{SPACE}+|{SPACE}+$", "")


def normalised(c: Column) -> Column:
    """Lower case, anything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def word(pattern: str) -> str:
    """The pattern between ASCII word borders."""
    return f"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def let(value: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule(value)`` with the value worked out once a row.

    A column that a rule names in several places is otherwise written out, and worked out, at each of them.
    """
    return F.transform(F.array(value), rule)[0]


def _either(pattern: str) -> list[str]:
    """The alternatives of a pattern, split at the bars outside its brackets."""
    out, depth = [""], 0
    for ch in pattern:
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return out


def holds(text: Column, pattern: str) -> Column:
    """``text.rlike(pattern)``: plain phrases are looked for as they are, plain words before their borders are."""
    tests = []
    for p in _either(pattern):
        plain = re.fullmatch(re.escape(word("@")).replace("@", "([a-z0-9 &]+)"), p)
        if re.fullmatch("[a-z0-9 &]+", p):
            tests.append(text.contains(p))
        else:
            tests.append(text.contains(plain[1]) & text.rlike(p) if plain else text.rlike(p))
    return reduce(Column.__or__, tests)


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value, never null, of the first test that holds."""
    return F.coalesce(*(F.when(test, value) for test, value in cases), otherwise)


# --- numbers ------------------------------------------------------------------------------------
def money(c: Column) -> Column:
    """Pounds as double: currency signs, commas and letters dropped; null if nothing numeric is left."""
    digits = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9.\\-]", "")
    return _number(F.regexp_extract(digits, "^-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)", 0))


def _number(text: Column) -> Column:
    """A text of digits as double, or null: an empty one isn't cast, as a failing cast costs more than all else here."""
    return let(text, lambda x: F.when(x != "", x.try_cast("double")))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def fte(c: Column) -> Column:
    """Full-time equivalent in (0, 5], else null; never a default."""
    digits = F.regexp_replace(clean(c), "[^0-9.]", "")
    v = _number(F.regexp_extract(digits, "^(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)", 0))
    return let(v, lambda x: F.when((x > 0) & (x <= 5), x))


def half_up(c: Column) -> Column:
    """floor(x + 0.5) as long."""
    return F.floor(c + 0.5).cast("long")


# --- status and holder --------------------------------------------------------------------------
# What a Name cell says about the post.
NOT_APPLICABLE = "(?i)^n[/. ]?a$"
UNDISCLOSED = "(?i)^n[/. ]?d$|not\\s*disclos|non[- ]?disclos|withheld|not\\s*provided|not\\s*published|undisclosed"
STATUS_WORDS = (("redacted", "(?i)redact"), ("vacant", "(?i)vacan"), ("eliminated", "(?i)eliminat|abolish|deleted post"), ("filled-undisclosed", UNDISCLOSED))


def status(name: Column) -> Column:
    return let(
        clean(name),
        lambda s: _first(
            [
                (s.rlike(NOT_APPLICABLE), F.lit("filled-undisclosed")),
                (s.isin("", "-", "--") | (F.lower(s) == "nan"), F.lit("blank")),
                *((s.rlike(p), F.lit(v)) for v, p in STATUS_WORDS),
            ],
            F.lit("filled-named"),
        ),
    )


def holder(name: Column) -> Column:
    """The published name, if the cell holds one: single-spaced, at most 80 characters."""
    return F.when(status(name) == "filled-named", F.substring(F.regexp_replace(clean(name), f"{SPACE}+", " "), 1, 80))


# --- grade --------------------------------------------------------------------------------------
# Grade rules in the order they are tried, on normalised text: (pattern, band, variant).
PERM, DG, DIR, DD, UNBANDED, MILITARY, SPECIALIST, BELOW, OTHER = (
    "SCS4 / Perm Sec",
    "SCS3 (Dir Gen)",
    "SCS2 (Dir)",
    "SCS1 (Dep Dir)",
    "SCS (band n/s)",
    "Military (OF-6+)",
    "Specialist (own scale)",
    "Below SCS",
    "Other / Not stated",
)
SPECIALISTS = (
    ("medical consultant|consultant psychiatrist|^consultant$", "Medical Consultant"),
    ("counsel", "Parliamentary Counsel"),
    ("senior commercial specialist", "Senior Commercial Specialist"),
    ("commercial specialist", "Commercial Specialist"),
    ("^slg", "SLG (DE&S)"),
    ("^afc", None),
    ("^esm", None),
)
NUMBERED = "scs\\s*(?:pay\\s*)?band\\s*([1-4])\\s*(a?)\\s*(london|national)?"
TITLES = (
    (f"perm(anent)? (under )?sec|permsec|cabinet secretary|second permanent|scs\\s*4|pay band 4|{word('pb4')}", PERM, None),
    (f"director general|{word('dg')}|scs\\s*3|pay band 3|{word('pb3')}", DG, None),
    ("scs\\s*1a|scs1a|pay band 1a", DD, "SCS1A"),
    (f"deputy director|{word('dd')}|scs\\s*1|pay band 1|{word('pb1')}", DD, None),
    (f"director|scs\\s*2|pay band 2|{word('pb2')}", DIR, None),
    ("scs", UNBANDED, None),
)
JUNIOR = (
    "grade 7", "grade7", "g7", "grade 6", "grade6", "g6", "grade 6 7", "seo", "heo", "eo", "ao", "aa", "ea ao", "fast st", "fast stream", "faststream", "fs",
    "band a", "band b", "band c", "band d", "band e", "executive officer", "higher executive officer", "senior executive officer",
    "administrative officer", "administrative assistant", "apprentice", "industrial", "non industrial",
)


def grade(raw: Column) -> Column:
    """struct(raw, band, variant, senior)."""
    whole = lambda r, b: F.struct(r.alias("raw"), b["band"].alias("band"), b["variant"].alias("variant"), b["band"].isin(*SENIOR_GRADES).alias("senior"))
    return let(clean(raw), lambda r: let(normalised(r), lambda n: let(_banded(r, n), lambda b: whole(r, b))))


def _banded(r: Column, n: Column) -> Column:
    """struct(band, variant) of a cell and its normalised text."""
    none = F.lit(None).cast("string")
    out = lambda band, variant=none: F.struct(F.lit(band).alias("band") if isinstance(band, str) else band.alias("band"), variant.alias("variant"))
    number, a, place = (F.regexp_extract(n, NUMBERED, k) for k in (1, 2, 3))
    by_number = F.element_at(F.array(F.lit(DD), F.lit(DIR), F.lit(DG), F.lit(PERM)), F.greatest(number.try_cast("int"), F.lit(1)))
    variant = F.when(place == "london", "London").when(place == "national", "National").when(a == "a", "SCS1A")
    cases = [
        ((r == "") | n.isin("nan", "na", "n a"), out(OTHER)),
        (n.rlike("^of\\s*[6-9]$"), out(MILITARY, F.concat(F.lit("OF-"), F.regexp_extract(n, "([6-9])$", 1)))),
        *((holds(n, p), out(SPECIALIST, F.lit(v) if v else F.upper(r))) for p, v in SPECIALISTS),
        (n.rlike(NUMBERED), out(by_number, variant)),
        *((holds(n, p), out(b, F.lit(v) if v else none)) for p, b, v in TITLES),
        (n.isin(*JUNIOR), out(BELOW)),
    ]
    return _first(cases, out(OTHER))


# --- profession ---------------------------------------------------------------------------------
# Profession rules in the order they are tried, on lower-case text.
DIGITAL = "Digital, Data & Technology"
PROFESSIONS = (
    ("Counter Fraud", f"counter[- ]?fraud|{word('fraud')}"),
    ("Occupational Psychology", "occupational psycholog|psycholog"),
    ("Operational Research", f"operational research|{word('or service')}"),
    ("Knowledge & Information Management", f"knowledge (and|&) information|{word('kim')}"),
    ("Inspector of Education and Training", "inspector of education|education and training inspect"),
    ("Planning Inspectors", "planning inspector"),
    ("Geography", "geograph"),
    ("Social Research", "social research"),
    ("Intelligence & Security", f"intelligence|national security|counter[- ]terror|{word('security')}"),
    ("Veterinary", f"veterinar|{word('vets?')}"),
    ("Military", f"{word('military')}|armed forces"),
    ("Internal Audit & Risk", f"audit|{word('risk')}|assurance"),
    ("Policy", "policy|polciy"),
    ("Economics", "econom"),
    ("Finance", "financ|account"),
    (DIGITAL, f"digital|{word('data|ict|cio|cdo|cto|it')}|technolog|cyber|software|architect"),
    ("Legal", f"legal|{word('law')}|solicitor|counsel|barrister"),
    ("Tax", f"{word('tax')}|revenue|customs"),
    ("Commercial", "commercial|procure|contract management|purchasing"),
    ("Project Delivery", f"project|programme|portfolio|{word('ppm')}"),
    ("Human Resources", f"human resource|{word('hr')}|people|workforce|reward"),
    ("Communications", f"communicat|{word('comms')}|media|press|marketing|external affairs"),
    ("Science & Engineering", f"scien|engineer|{word('stem')}"),
    ("Statistics", f"statistic|{word('stats?')}|analysis|analyst|data science"),
    ("Operational Delivery", "operational|operations|op del|service delivery|casework"),
    ("Medical & Health", f"medic|clinical|(?<![A-Za-z0-9_])nurs|{word('health')}|public health|pharmac|dental"),
    ("Property & Estates", "property|estates?|facilit|surveyor|asset management"),
    ("Planning", "planning"),
)
NON_ANSWER = "^(undefined|unspecified|unknown|missing data|not (stated|applicable|reported|recorded)|n/?a|none|nil|nan|tbc|unassigned( profession)?)$"
DIGITAL_TITLE = f"(?i)technolog|cyber|software|{word('digital|data|ict|cio|cdo|cto')}"


def profession(group: Column, title: Column) -> Column:
    """struct(raw, prof, source): from the group, else from the title, else a stated non-answer."""
    of = lambda c: let(c, lambda x: _first([(holds(x, p), F.lit(name)) for name, p in PROFESSIONS], F.lit(None)))
    read = lambda prof, source: F.when(prof.isNotNull(), F.struct(prof.alias("prof"), F.lit(source).alias("source")))
    t = F.lower(F.coalesce(title, F.lit("")))

    def found(g: Column, silent: Column) -> Column:
        from_group = let(F.when(~silent, of(g)), lambda x: read(x, "group"))
        from_title = let(F.when(silent | g.rlike("^other|other$"), of(t)), lambda x: read(x, "title"))
        return F.coalesce(from_group, from_title, read(F.when(silent, "Not stated").otherwise("Other"), "none"))

    whole = lambda raw, x: F.struct(raw.alias("raw"), x["prof"].alias("prof"), x["source"].alias("source"))
    known = lambda g: let((g == "") | g.rlike(NON_ANSWER), lambda silent: found(g, silent))
    return let(clean(group), lambda raw: let(let(F.lower(raw), known), lambda x: whole(raw, x)))


def is_digital(prof: Column, title: Column) -> Column:
    """A digital post; "IT" counts in capitals only."""
    t = F.coalesce(title, F.lit(""))
    return (prof == DIGITAL) | t.rlike(word("IT")) | t.rlike(DIGITAL_TITLE)


def is_policy(prof: Column, title: Column) -> Column:
    return (prof == "Policy") | F.coalesce(title, F.lit("")).rlike(f"(?i){word('policy')}")


# --- pay bands ----------------------------------------------------------------------------------
PLAUSIBLE = (30_000, 800_000)


def disclosure(floor_raw: Column, ceil_raw: Column) -> Column:
    """struct(floor, ceil, disclosed, reason, bin_low, bin_high) of two published cells.

    An implausible pair keeps its edges but counts as withheld.
    """
    edge = lambda x: let(money(x), positive)
    binned = lambda b: F.struct(*(b[x].alias(x) for x in ("floor", "ceil")), b["reason"].isNull().alias("disclosed"), b["reason"].alias("reason"), *_bins(b))
    judged = lambda fr, cr: let(edge(fr), lambda lo: let(edge(cr), lambda hi: let(_withheld(fr, cr, lo, hi), binned)))
    return let(clean(floor_raw), lambda fr: let(clean(ceil_raw), lambda cr: judged(fr, cr)))


def _bins(band: Column) -> tuple[Column, Column]:
    shown = lambda x: F.when(band["reason"].isNull(), band[x])
    low, high = band_bins(shown("floor"), shown("ceil"))
    return low.alias("bin_low"), high.alias("bin_high")


def _withheld(fr: Column, cr: Column, lo: Column, hi: Column) -> Column:
    """struct(floor, ceil, reason) of two cleaned cells and their amounts."""
    both = F.trim(F.concat_ws(" ", fr, cr))
    zero = "^0([.,]0+)?$"
    shown = lo.isNotNull() | hi.isNotNull()
    odd = (F.coalesce(hi, lo) < PLAUSIBLE[0]) | (F.coalesce(lo, hi) > PLAUSIBLE[1])
    reason = (
        F.when(~shown & (both == ""), "blank")
        .when(~shown & (fr.rlike(zero) | cr.rlike(zero)), "zero")
        .when(~shown & both.rlike("(?i)n/?a|n/?d|not disclosed|withheld|redact"), "N/A")
        .when(~shown, "other")
        .when(odd, "implausible")
    )
    return F.struct(lo.alias("floor"), hi.alias("ceil"), reason.alias("reason"))


def band_bins(floor: Column, ceil: Column) -> tuple[Column, Column]:
    """Bin indices of a band: withheld without edges, open with one."""
    lo, hi = positive(floor), positive(ceil)
    none = lo.isNull() & hi.isNull()
    one = lo.isNull() | hi.isNull()
    pick = lambda edge: F.when(none, BAND_WITHHELD).when(one, BAND_OPEN).otherwise(F.floor(edge / BIN)).cast("int")
    return pick(F.least(lo, hi)), pick(F.greatest(lo, hi))


def band_state(bin_low: Column) -> Column:
    return F.when(bin_low >= 0, "banded").when(bin_low == BAND_OPEN, "open").otherwise("withheld")


def identifier(c: Column) -> Column:
    """A post reference; placeholders become empty."""
    return let(clean(c), lambda s: F.when(s.rlike("(?i)^(xx+|n/?a|none|-+)$"), "").otherwise(s))


# --- lists of high earners ----------------------------------------------------------------------
def amount(c: Column) -> Column:
    """Pounds; "40k" is forty thousand."""
    s = clean(c)
    return money(s) * F.when(s.rlike("(?i)[0-9]\\s*k$"), 1000).otherwise(1)


def pay_range(c: Column) -> Column:
    """struct(lo, hi) of "174000 - 179999"; a single amount is both."""
    parts = F.filter(F.split(clean(c), "(?i)\\s*(?:-|–|—|to)\\s*"), lambda x: x != "")
    return F.struct(amount(F.get(parts, 0)).alias("lo"), amount(F.coalesce(F.get(parts, 1), F.get(parts, 0))).alias("hi"))


def pay_shape(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNull() & hi.isNull(), "not-published").when(hi.isNull(), "floor-only").when(lo.isNull() | (lo == hi), "exact").otherwise("band")


# --- suppression --------------------------------------------------------------------------------
# Published markers and what they say.
SUPPRESSED = {"x": "unreliable", ":": "not-available", "..": "disclosive", "-": "nil-or-negligible", "[c]": "confidential", "[n]": "not-reliable", "[z]": "not-applicable", "[w]": "not-available"}


def suppressed_cell(c: Column) -> Column:
    """struct(value, reason): a marker is null with its reason, never zero."""
    s = F.lower(clean(c))
    reasons = F.create_map(*(F.lit(x) for kv in SUPPRESSED.items() for x in kv))
    value = F.regexp_replace(s, "[£,]", "").try_cast("double")
    reason = F.coalesce(F.try_element_at(reasons, s), F.when(value.isNull(), F.when(s == "", "blank").otherwise("unparseable")))
    return F.struct(F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def n_gate(value: Column, n: Column, least: int = 30) -> Column:
    """struct(value, n_known): null below the least n; an unknown n is let through and said so."""
    return F.struct(F.when(n.isNull() | (n >= least), value).alias("value"), n.isNotNull().alias("n_known"))
