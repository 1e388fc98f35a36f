"""Columnar JSON shards and registries to rows and back; Parquet stores by organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def to_rows(df: DataFrame, data: str, columns: list[str], keep: list[str]) -> DataFrame:
    """A struct of equally long arrays to one row per position, with ``pos``.

    Raises at run time if a column's length differs: a shard that was cut short must not decode.
    """
    lengths = F.array(*(F.size(f"{data}.{c}") for c in columns))
    even = F.array_min(lengths) == F.array_max(lengths)
    zipped = F.when(even, F.arrays_zip(*(F.col(f"{data}.{c}") for c in columns))).otherwise(F.raise_error(F.lit("columns of unequal length")))
    return df.select(*keep, F.posexplode(zipped).alias("pos", "x")).select(*keep, "pos", *(F.col("x")[c].alias(c) for c in columns))


def looked_up(index: Column, dictionary: Column) -> Column:
    """The dictionary's entry; -1 and what lies outside are null."""
    return F.when(index >= 0, F.get(dictionary, index))


def to_columns(df: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Rows to one struct of arrays per group, in order."""
    packed = F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order))))
    return df.groupBy(*by).agg(packed.alias("p")).select(*by, F.struct(*(F.col(f"p.{c}").alias(c) for c in columns)).alias("data"))


def parts_of(snapshots: DataFrame, parts: str = "parts") -> DataFrame:
    """Each snapshot's slice of the flattened parts: offsets are running sums of the counts.

    The registry is one document of some thousand snapshots, ordered by ``pos``.
    """
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("part_count").over(w), F.lit(0)).cast("int")
    return snapshots.withColumn("own_parts", F.slice(parts, start + 1, F.col("part_count").cast("int")))


def dictionary(df: DataFrame, column: str, order: Column | None = None) -> DataFrame:
    """(column, id): dense ids from 0, by first appearance if ``order`` is given, else by value."""
    first = df.groupBy(column).agg(F.min(order if order is not None else F.col(column)).alias("at"))
    return first.withColumn("id", F.row_number().over(Window.orderBy("at", column)) - 1).drop("at")


def write_by_org(df: DataFrame, path: str) -> None:
    """Parquet with one folder per organisation, so a read of some prunes the rest."""
    df.repartition("org").write.mode("overwrite").partitionBy("org").parquet(path)


def read_orgs(spark: SparkSession, path: str, orgs: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if orgs is None else df.where(F.col("org").isin(*orgs))
