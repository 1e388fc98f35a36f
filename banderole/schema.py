"""Types, sentinels and closed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame

BIN = 5000
BAND_WITHHELD = -1
BAND_OPEN = -2
THIN = 30

# Closed vocabularies, in their order.
STATUSES = ("filled-named", "filled-undisclosed", "vacant", "eliminated", "redacted", "blank")
WITHHELD_REASONS = ("blank", "zero", "N/A", "other", "implausible")
CONFIDENCES = ("declared", "inferred", "default")
GRADES = (
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
SCS_GRADES = GRADES[:5]
SENIOR_GRADES = GRADES[:7]

POST = (
    "pur string, ordinal int, status string, holder string, title string, unit string, organisation string, parent_dept string,"
    " reports_to string, cost_of_reports bigint, region string, grade_raw string, grade string, variant string, prof_raw string,"
    " prof string, prof_source string, ddat boolean, pol boolean, fte double, floor double, ceil double, disclosed boolean,"
    " withheld_reason string, bin_low int, bin_high int"
)


def assert_schema(df: DataFrame, expected: str) -> DataFrame:
    """``df`` if it has the expected columns and types (DDL), in any order; else ValueError."""
    have = dict(df.dtypes)
    wrong = [x.strip() for x in expected.split(",") if have.get(x.split()[0]) != x.split()[1]]
    if wrong:
        raise ValueError("missing or of another type: " + ", ".join(wrong))
    return df
