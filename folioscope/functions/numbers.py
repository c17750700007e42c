"""Number columns: rounding, powers, slopes, ranges, line intersection and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def round_to(value: Column, places: int) -> Column:
    """Nearest multiple of ``10 ** -places``, halves upwards."""
    unit = float(10**places)
    return F.floor(value * unit + 0.5) / unit


def power(base: Column, exponent: float) -> Column:
    return F.pow(base, F.lit(exponent))


def slope(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Rise over run; null for a vertical line."""
    return (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))


def number_range(start: Column, stop: Column, step: int = 1) -> Column:
    """Numbers from ``start`` up to but without ``stop``."""
    return F.when(start < stop, F.sequence(start, stop - 1, F.lit(step))).otherwise(
        F.array().cast("array<bigint>")
    )


def line_intersection(a: Point, b: Point, c: Point, d: Point) -> Point:
    """Where the line through a and b meets the line through c and d; nulls if they are parallel."""
    run, rise = b[0] - a[0], b[1] - a[1]
    other_run, other_rise = d[0] - c[0], d[1] - c[1]
    cross = F.nullif(run * other_rise - rise * other_run, F.lit(0.0))
    along = ((c[0] - a[0]) * other_rise - (c[1] - a[1]) * other_run) / cross
    return a[0] + along * run, a[1] + along * rise


def grid_cell(x: Column, y: Column, size_x: float, size_y: float) -> Point:
    """Cell of a point, truncated towards zero."""
    return (x / size_x).cast("bigint"), (y / size_y).cast("bigint")
