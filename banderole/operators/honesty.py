"""Audit of figures in nested tables: no coerced zeros, nothing without a source, nothing stale or unmarked.

The walk over structs, arrays and maps follows the schema, so it becomes one expression per row without shuffles or Python; what
it finds are rows with the path to the place.  A source is inherited: a table names it once, and everything below has it.

Edge cases: null structs, arrays and fields hold nothing and break no rule; a key that is null isn't there; a NaN isn't zero; maps are walked by key; tables
without nested columns are audited at the top; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Statistics that are never zero, what makes a node a figure, what names its source, and how sure one can be.
STATISTICS = ("median", "mean", "p25", "p75", "p90", "min", "max")
FIGURES = ("median", "marketComparison")
SOURCES = ("src", "id", "sourceUrl")
CONFIDENCE = ("fact", "hypothesis", "contested")
STALE_MONTHS = 14
DAYS_A_MONTH = 30.44

FOUND = "array<struct<path:string,problem:string>>"
ZERO = "exactly zero: a suppression was coerced"
UNSOURCED = "figures without a source here or above"


def _nothing() -> Column:
    return F.array().cast(FOUND)


def _problem(test: Column, path: Column, what: str) -> Column:
    return F.when(test, F.array(F.struct(path.alias("path"), F.lit(what).alias("problem")))).otherwise(_nothing())


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) or (isinstance(kind, T.ArrayType) and _nested(kind.elementType)) or (isinstance(kind, T.MapType) and _nested(kind.valueType))


def walk(node: Column, kind: T.DataType, path: Column, sourced: Column) -> Column:
    """array of (path, problem) at and below a node."""
    if isinstance(kind, T.ArrayType):
        below = F.flatten(F.transform(node, lambda x, i: walk(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), sourced)))
        return F.coalesce(below, _nothing())
    if isinstance(kind, T.MapType):
        below = F.flatten(F.transform(F.map_entries(node), lambda e: walk(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string")), sourced)))
        return F.coalesce(below, _nothing())
    fields = {f.name: f.dataType for f in kind.fields}
    here = sourced
    for name in SOURCES:
        if name in fields:
            here = here | node[name].isNotNull()
    found = [_problem(node[k].cast("double") == 0, F.concat(path, F.lit(f".{k}")), ZERO) for k in STATISTICS if isinstance(fields.get(k), T.NumericType)]
    figures = [node[k].isNotNull() for k in FIGURES if k in fields]
    if figures:
        found.append(_problem((figures[0] if len(figures) == 1 else figures[0] | figures[1]) & ~here, path, UNSOURCED))
    found += [walk(node[k], t, F.concat(path, F.lit(f".{k}")), here) for k, t in fields.items() if _nested(t)]
    return F.when(node.isNotNull(), F.concat(*found)).otherwise(_nothing()) if found else _nothing()


def figures(tables: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, path, problem) of the nested columns."""
    kinds = {f.name: f.dataType for f in tables.schema.fields}
    found = [walk(F.col(f"`{c}`"), kinds[c], F.lit(c), F.lit(False)) for c in columns]
    return tables.select(*keys, F.inline(F.concat(*found)))


def curated(entries: DataFrame, today: Column) -> DataFrame:
    """(id, problem) of figures kept by hand: ``entries`` has id, lastReviewed, verified, resolved, sourceUrl, confidence and whether it has_values.

    An entry that was never reviewed has that problem alone.
    """
    age = F.datediff(today, F.col("lastReviewed")) / DAYS_A_MONTH
    open_ = F.col("has_values") & ~F.coalesce(~F.col("resolved"), F.lit(False))  # resolved: false is a mark, null isn't
    rules = F.array_compact(
        F.array(
            F.when(age > STALE_MONTHS, "reviewed too long ago"),
            F.when(F.col("verified").isNull(), "no verified flag"),
            F.when(open_ & (F.col("verified") == F.lit(False)), "unverified values that aren't marked"),
            F.when(open_ & (F.coalesce("sourceUrl", F.lit("")) == ""), "values without a source that aren't marked"),
            F.when(~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False)), "confidence of no known kind"),
        )
    )
    return entries.select("id", F.explode(F.when(F.col("lastReviewed").isNull(), F.array(F.lit("never reviewed"))).otherwise(rules)).alias("problem"))
