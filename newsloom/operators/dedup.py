"""Duplicates and caps, each with a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import blank_to_null


def ranked(df: DataFrame, key: list, order: list, into: str = "__rank") -> DataFrame:
    """Rank within a key. A hash of the key leads it, so that sorting seldom compares long texts; a limit on the rank
    reaches the map side (WindowGroupLimit), so a key with a third of all rows sends a few rows per task."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(F.xxhash64(*key), *key).orderBy(*order)))


def keep_first(df: DataFrame, key: list, order: list) -> DataFrame:
    return ranked(df, key, order).where("__rank = 1").drop("__rank")


def keep_last(df: DataFrame, key: list, order: list[str]) -> DataFrame:
    return keep_first(df, key, [F.col(c).desc() for c in order])


def mark_later(df: DataFrame, column: str, order: list) -> DataFrame:
    """All rows stay; a value's later occurrences become null."""
    return ranked(df, [column], order).withColumn(column, F.when(F.col("__rank") == 1, F.col(column))).drop("__rank")


def cap_per_key(df: DataFrame, key: list, order: list, most: int) -> DataFrame:
    return ranked(df, key, order).where(F.col("__rank") <= most).drop("__rank")


def ordered_distinct(df: DataFrame, key: list[str], value: str, order: str, into: str = "values") -> DataFrame:
    """Per key its different values, each at the place of its first occurrence. Occurrences are reduced to one a value before
    they are gathered."""
    first = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(order).alias("__at"))
    listed = F.array_sort(F.collect_list(F.struct("__at", value)))
    return first.groupBy(*key).agg(F.transform(listed, lambda x: x[value]).alias(into))


def content_hash(md: Column, html: Column) -> Column:
    return F.sha2(F.coalesce(blank_to_null(md), html, F.lit("")), 256)


def distinct_contents(df: DataFrame, hash_column: str, order: list[str]) -> DataFrame:
    """One row per content hash, the last writer's, and how many rows had it."""
    latest = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(F.col(hash_column).alias("__h")).agg(latest, F.count(F.lit(1)).alias("n_rows")).select("r.*", "n_rows")
