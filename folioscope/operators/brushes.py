"""Selections on parallel axes: ranges, line cuts and angles, with their scales and bundling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ordering import global_rank

Range = tuple[float, float]
PREDICATES = ("AND", "OR")


def check_predicate(mode: str) -> str:
    if mode not in PREDICATES:
        raise ValueError(f"predicate {mode!r} is none of {PREDICATES}")
    return mode


def _combine(conditions: Sequence[Column], mode: str) -> Column:
    if check_predicate(mode) == "AND":
        return reduce(lambda a, b: a & b, conditions)
    return reduce(lambda a, b: a | b, conditions)


def ordinal_domain(df: DataFrame, dim: str) -> DataFrame:
    """Distinct strings of a column with their place, rarest first, ties by value."""
    counts = df.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return global_rank(counts, [F.col("n"), F.col("value")], "place", start=0)


def brush_multi_extent(
    df: DataFrame,
    extents: Mapping[str, Sequence[Range]],
    mode: str = "AND",
    ordinal: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Rows inside any of the ranges of each axis, axes combined by AND or OR, both ends inclusive.

    No range at all keeps every row. Columns in ``ordinal`` are strings: their ranges are places in the
    domain table. Plain ranges become scan filters.
    """
    check_predicate(mode)
    active = {dim: ranges for dim, ranges in extents.items() if ranges}
    if not active:
        return df
    columns, conditions = df.columns, []
    for dim, ranges in active.items():
        measured = F.col(dim)
        if ordinal and dim in ordinal:
            places = ordinal[dim].select(F.col("value").alias(dim), F.col("place").alias(f"_place_{dim}"))
            df = df.join(places, dim, "left")
            measured = F.col(f"_place_{dim}")
        conditions.append(reduce(lambda a, b: a | b, [measured.between(lo, hi) for lo, hi in ranges]))
    return df.filter(_combine(conditions, mode)).select(*columns)


def brush_axis(
    df: DataFrame,
    extents: Mapping[str, Range],
    mode: str = "AND",
    ordinal: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Rows inside the range of each axis, axes combined by AND or OR."""
    return brush_multi_extent(df, {dim: [r] for dim, r in extents.items()}, mode, ordinal)


def axis_extent(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Least and greatest value of each numeric axis, long form (dim, lo, hi)."""
    found = df.agg(*[F.struct(F.min(d).cast("double").alias("lo"), F.max(d).cast("double").alias("hi")).alias(d) for d in dims])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{d}.lo"), F.col(f"{d}.hi")) for d in dims]))
    return found.select(rows.alias("r")).select("r.dim", "r.lo", "r.hi")


def common_extent(extents: DataFrame) -> DataFrame:
    """One extent over all axes."""
    return extents.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def axis_scale(value: Column, lo: Column, hi: Column, height: float) -> Column:
    """Place on a vertical axis: the least value at ``height + 1``, the greatest at 1."""
    share = (value - lo) / F.nullif(hi - lo, F.lit(0.0))
    return F.lit(height + 1.0) - F.lit(float(height)) * share


def scaled_axes(df: DataFrame, dims: Sequence[str], height: float, common: bool = False) -> DataFrame:
    """Replace every axis column by its place; extents arrive as one scalar row."""
    lows = [F.min(d).cast("double") for d in dims]
    highs = [F.max(d).cast("double") for d in dims]
    if common and len(dims) > 1:
        lows, highs = [F.least(*lows)] * len(dims), [F.greatest(*highs)] * len(dims)
    fields = [c.alias(f"lo_{d}") for c, d in zip(lows, dims)] + [c.alias(f"hi_{d}") for c, d in zip(highs, dims)]
    extents = df.agg(F.struct(*fields).alias("e")).scalar()
    placed = df.withColumn("_e", extents)
    for d in dims:
        placed = placed.withColumn(
            d, axis_scale(F.col(d).cast("double"), F.col(f"_e.lo_{d}"), F.col(f"_e.hi_{d}"), height)
        )
    return placed.drop("_e")


@dataclass(frozen=True)
class Strum:
    """A line drawn between two neighbouring axes; x counts from the left axis."""

    left: str
    right: str
    start: tuple[float, float]
    end: tuple[float, float]
    width: float

    def crossed_by(self, left: Column, right: Column) -> Column:
        """The row's segment passes the two ends of the line on different sides."""

        def above(point: tuple[float, float]) -> Column:
            at = left + (right - left) * F.lit(point[0] / self.width)
            return at - F.lit(point[1])

        return above(self.start) * above(self.end) < 0


@dataclass(frozen=True)
class Arc:
    """An interval of segment angles, in radians, between two neighbouring axes."""

    left: str
    right: str
    start: float
    end: float
    width: float

    def holds(self, left: Column, right: Column) -> Column:
        drop = left - right
        angle = F.asin(drop / F.hypot(F.lit(float(self.width)), drop))
        return angle.between(min(self.start, self.end), max(self.start, self.end))


def brush_strum(df: DataFrame, strums: Sequence[Strum], height: float, mode: str = "AND") -> DataFrame:
    """Rows whose segments cross the lines, strictly."""
    check_predicate(mode)
    if not strums:
        return df
    return _brush_segments(df, strums, height, mode, [(s, s.crossed_by) for s in strums])


def brush_angle(df: DataFrame, arcs: Sequence[Arc], height: float, mode: str = "AND") -> DataFrame:
    """Rows whose segment angles lie in the intervals, both ends inclusive."""
    check_predicate(mode)
    if not arcs:
        return df
    return _brush_segments(df, arcs, height, mode, [(a, a.holds) for a in arcs])


def _brush_segments(df, shapes, height, mode, tests):
    dims = sorted({d for s in shapes for d in (s.left, s.right)})
    kept = df.columns
    copies = df.select(*kept, *[F.col(d).alias(f"_y_{d}") for d in dims])
    placed = scaled_axes(copies, [f"_y_{d}" for d in dims], height)
    conditions = [test(F.col(f"_y_{s.left}"), F.col(f"_y_{s.right}")) for s, test in tests]
    return placed.filter(_combine(conditions, mode)).select(*kept)


def hide_dimensions(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.drop(*dims)


def highlight_rows(df: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """Flag the rows whose key is in a given set."""
    listed = marked.select(key).distinct().withColumn("_hit", F.lit(True))
    return df.join(listed, key, "left").withColumn("highlighted", F.coalesce("_hit", F.lit(False))).drop("_hit")


def infer_dim_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Type of each string column over all its values: number, else date, else string."""
    aggregates = []
    for c in columns:
        value = F.nullif(F.col(c), F.lit(""))
        aggregates += [
            F.count(value).alias(f"{c}__n"),
            F.count(value.try_cast("double")).alias(f"{c}__number"),
            F.count(value.try_cast("timestamp")).alias(f"{c}__date"),
        ]
    found = df.agg(*aggregates)

    def kind(c: str) -> Column:
        n = F.col(f"{c}__n")
        return (
            F.when(n == 0, F.lit("string"))
            .when(F.col(f"{c}__number") == n, F.lit("number"))
            .when(F.col(f"{c}__date") == n, F.lit("date"))
            .otherwise(F.lit("string"))
        )

    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), kind(c).alias("type")) for c in columns]))
    return found.select(rows.alias("r")).select("r.dim", "r.type")


def unpivot_axes(df: DataFrame, dims: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long form (keys, dim, idx, value) of the axis columns, in axis order."""
    entries = [
        F.struct(F.lit(d).alias("dim"), F.lit(i).alias("idx"), F.col(d).cast("double").alias("value"))
        for i, d in enumerate(dims)
    ]
    return df.select(*keys, F.explode(F.array(*entries)).alias("r")).select(*keys, "r.dim", "r.idx", "r.value")


def adjacent_pairs(dims: DataFrame) -> DataFrame:
    """Neighbouring dimensions of an ordered dimension table (dim, idx), one row per pair."""
    return (
        dims.withColumn("right", F.lead("dim").over(Window.orderBy("idx")))
        .filter(F.col("right").isNotNull())
        .select(F.col("dim").alias("left"), "right")
    )


def bundle_centroids(placed: DataFrame, dims: Sequence[str], bundle: str) -> DataFrame:
    """Mean place on every axis per value of the bundle column, one row per bundle."""
    return placed.groupBy(bundle).agg(*[F.avg(d).alias(f"center_{d}") for d in dims])


def bundle_points(
    placed: DataFrame, dims: Sequence[str], bundle: str, strength: float, keys: Sequence[str]
) -> DataFrame:
    """Point between neighbouring axes per row, pulled from the segment's middle toward the middle of
    its bundle's centroids: c + (1 - strength) * (y - c)."""
    joined = placed.join(bundle_centroids(placed, dims, bundle), bundle)
    points = []
    for i, (left, right) in enumerate(zip(dims, dims[1:])):
        middle = (F.col(left) + F.col(right)) / 2
        centre = (F.col(f"center_{left}") + F.col(f"center_{right}")) / 2
        pulled = centre + F.lit(1.0 - strength) * (middle - centre)
        points.append(F.struct(F.lit(i).alias("gap"), F.lit(left).alias("left"), F.lit(right).alias("right"), pulled.alias("y")))
    return joined.select(*keys, F.explode(F.array(*points)).alias("p")).select(*keys, "p.gap", "p.left", "p.right", "p.y")


def reorder_dimensions(placed: DataFrame, dims: Sequence[str], row: Column) -> DataFrame:
    """Order of the axes by the places of one row, ties by name. One row, so the window is d entries."""
    entries = F.array_sort(F.array(*[F.struct(F.col(d).alias("place"), F.lit(d).alias("dim")) for d in dims]))
    chosen = placed.filter(row).select(F.posexplode(entries).alias("idx", "e"))
    return chosen.select(F.col("e.dim").alias("dim"), F.col("idx").cast("bigint").alias("idx"))
