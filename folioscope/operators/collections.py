"""List helpers on whole tables: sets, first per key, grouping, extremes, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, test: Column) -> DataFrame:
    return df.filter(test)


def reject(df: DataFrame, test: Column) -> DataFrame:
    """Rows that fail the test; a null test counts as failed."""
    return df.filter(~F.coalesce(test, F.lit(False)))


def find(df: DataFrame, test: Column, order: Sequence[Column]) -> DataFrame:
    """First row that passes, in a given order: one row per task, then one."""
    return df.filter(test).orderBy(*order).limit(1)


def pluck(df: DataFrame, column: str) -> DataFrame:
    return df.select(column)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the first table without a partner in the second; repeats stay."""
    return a.join(b.select(*on).distinct(), list(on), "left_anti")


def uniq(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a given order, by a partial minimum instead of a window over hot keys."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def extremes(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """Position of the greatest value per key, last on ties, and of the least, first on ties."""
    return df.groupBy(*keys).agg(
        F.max(F.struct(value, position))[position].alias("max_by"),
        F.min(F.struct(value, position))[position].alias("min_by"),
    )


def any_every(df: DataFrame, keys: Sequence[str], test: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_or(test).alias("any"), F.bool_and(test).alias("every"))


def size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("size"))


def sorted_index(df: DataFrame, value: str, x: Column) -> DataFrame:
    """Place at which a number enters the sorted column: the count of smaller values."""
    return df.agg(F.count_if(F.col(value) < x).alias("place"))


def group_counts(df: DataFrame, keys: Sequence[str], fold: Column) -> DataFrame:
    """Group rows by key and fold each group; the fold is an aggregate, so groups are never gathered."""
    return df.groupBy(*keys).agg(fold)
