"""Columns over array-of-double vectors. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
PRECISION = 1e-6


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; a lambda would evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def unit(a: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    return bind(norm(a), lambda length: F.when(length == 0, a).otherwise(scale(a, F.lit(1.0) / length)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def haversine(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Great-circle distance in kilometres."""
    d_lat, d_lon = F.radians(lat_b - lat_a), F.radians(lon_b - lon_a)
    h = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(d_lon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def angle(a: Column, b: Column) -> Column:
    """Angle in radians; null if one vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size != 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))))


def largest(a: Column) -> Column:
    """The element of greatest absolute value."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: F.when(F.abs(x) > F.abs(acc), x).otherwise(acc))


def index_of(a: Column, value: Column) -> Column:
    """1-based position of the first equal element; null if there is none."""
    found = F.array_position(a, value)
    return F.when(found > 0, found)


def rounded(a: Column) -> Column:
    """Every element to the nearest whole number, halves upwards."""
    return F.transform(a, lambda x: F.floor(x + 0.5).cast("double"))


def nearly_equal(a: Column, b: Column) -> Column:
    same_size = F.size(a) == F.size(b)
    return same_size & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= PRECISION)


def is_parallel(a: Column, b: Column) -> Column:
    return F.abs(angle(a, b)) <= PRECISION


def is_antiparallel(a: Column, b: Column) -> Column:
    return F.abs(angle(a, b) - F.pi()) <= PRECISION


def is_perpendicular(a: Column, b: Column) -> Column:
    return F.abs(dot(a, b)) <= PRECISION


def minmax_within(a: Column) -> Column:
    """Scale a vector to [0, 1] by its own extremes; a constant vector gives nulls."""
    bounds = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
    return bind(
        bounds, lambda b: F.transform(a, lambda x: (x - b["lo"]) / F.nullif(b["hi"] - b["lo"], F.lit(0.0)))
    )
