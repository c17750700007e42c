"""Columns over arrays and maps: the list and record helpers of an explorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


def compact(items: Column) -> Column:
    """Drop nulls, blanks, zeros and false values of a string array."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def without(items: Column, *values) -> Column:
    """Drop the listed values; repeats of others stay."""
    return F.filter(items, lambda x: ~x.isin(list(values)))


def first_n(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def last_n(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n, F.lit(0)) + 1, F.lit(n))


def initial(items: Column, n: int = 1) -> Column:
    """All but the last ``n``."""
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - n, F.lit(0)))


def rest(items: Column, n: int = 1) -> Column:
    """All from place ``n`` on."""
    return F.slice(items, F.lit(n + 1), F.greatest(F.size(items) - n, F.lit(0)))


def index_of(items: Column, value: Column) -> Column:
    """0-based place of the first equal item, -1 if there is none."""
    return F.array_position(items, value) - 1


def last_index_of(items: Column, value: Column) -> Column:
    """0-based place of the last equal item, -1 if there is none."""
    back = F.array_position(F.reverse(items), value)
    return F.when(back == 0, F.lit(-1).cast("bigint")).otherwise(F.size(items) - back)


def sorted_index(items: Column, value: Column) -> Column:
    """Place at which a value enters a sorted array: the number of smaller items."""
    return F.size(F.filter(items, lambda x: x < value)).cast("bigint")


def uniq(items: Column) -> Column:
    return F.array_distinct(items)


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def difference(a: Column, b: Column) -> Column:
    """Items of the first array that the second lacks; repeats stay."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def any_of(items: Column, test: Test) -> Column:
    return F.exists(items, test)


def every(items: Column, test: Test) -> Column:
    return F.forall(items, test)


def find(items: Column, test: Test) -> Column:
    """First item that passes, null if none does."""
    return F.get(F.filter(items, test), F.lit(0))


def reject(items: Column, test: Test) -> Column:
    return F.filter(items, lambda x: ~test(x))


def max_by(items: Column, value: Callable[[Column], Column]) -> Column:
    """Item of greatest value, the last one on ties."""
    ranked = F.transform(items, lambda x, i: F.struct(value(x).alias("v"), i.alias("i"), x.alias("x")))
    return F.array_max(ranked)["x"]


def min_by(items: Column, value: Callable[[Column], Column]) -> Column:
    """Item of least value, the first one on ties."""
    ranked = F.transform(items, lambda x, i: F.struct(value(x).alias("v"), i.alias("i"), x.alias("x")))
    return F.array_min(ranked)["x"]


def sort_by(items: Column, value: Callable[[Column], Column]) -> Column:
    """Items by value, in their old order on ties."""
    ranked = F.transform(items, lambda x, i: F.struct(value(x).alias("v"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda r: r["x"])


def merge(record: Column, other: Column) -> Column:
    """Entries of both maps; the second one wins."""
    kept = F.map_filter(record, lambda k, _: ~F.map_contains_key(other, k))
    return F.map_concat(kept, other)


def defaults(record: Column, fallback: Column) -> Column:
    """Entries of both maps; the first one wins."""
    return merge(fallback, record)
