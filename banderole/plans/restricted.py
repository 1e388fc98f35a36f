"""Series narrowed to some groups, against the same groups cut out of the whole series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import filters
from ..operators import series as s
from .pay import run
from .stand_in import query, series_sql

CHOSEN = {"family": ("ASIA", "EUROPE"), "grade": ("1-URGENT", "5-LOW"), "profession": ("BUILDING", "MACHINERY"), "org": ("NATION_0", "NATION_1", "NATION_10")}
_GROUP = {"family": "c.family", "grade": "c.grade", "profession": "c.prof", "org": "c.org"}


def _slice(dimension: str) -> str:
    keys = ", ".join(f"'{k}'" for k in CHOSEN[dimension])
    return f"SELECT '{dimension}' AS dimension, * FROM ({series_sql('group_key, period, headcount, n, orgs_filed', group=_GROUP[dimension])}) WHERE group_key IN ({keys})"


@query(" UNION ALL ".join(map(_slice, CHOSEN)))
def restricted_series(spark, sf):
    """For each dimension the series of a filter made from group keys; the SQL cuts the whole series."""
    parts = []
    for dimension, keys in CHOSEN.items():
        f = filters.restrict(s.Filter(), dimension, list(keys))
        parts.append(run(spark, sf, ["headcount"], f, dimension).select(F.lit(dimension).alias("dimension"), "group_key", "period", "headcount", "n", "orgs_filed"))
    return reduce(lambda a, b: a.unionByName(b), parts)
