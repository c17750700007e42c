"""Convex hulls of point groups."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64
#: Directions in which the outermost point of each group is taken before Python sees any point.
DIRECTIONS = 16


def _chain(points: np.ndarray) -> list[np.ndarray]:
    """One side of a hull: keep left turns only."""
    side: list[np.ndarray] = []
    for p in points:
        while len(side) >= 2:
            (ax, ay), (bx, by) = side[-1] - side[-2], p - side[-2]
            if ax * by - ay * bx > 0:
                break
            side.pop()
        side.append(p)
    return side[:-1]


def hull_points(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the least point; up to three points all stay."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    if len(points) == 3:
        (ax, ay), (bx, by) = points[1] - points[0], points[2] - points[0]
        return points if ax * by - ay * bx >= 0 else points[[0, 2, 1]]
    corners = np.array(_chain(points) + _chain(points[::-1]))
    return corners


def _outermost(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by`` and ``ring``: the outermost point of each group in every direction, counter-clockwise."""
    turns = [2 * math.pi * k / DIRECTIONS for k in range(DIRECTIONS)]
    along = [F.col("x") * math.cos(t) + F.col("y") * math.sin(t) for t in turns]
    ends = [F.max_by(F.struct("x", "y"), a).alias(f"_{k}") for k, a in enumerate(along)]
    return rows.groupBy(*by).agg(*ends).select(*by, F.array(*(f"_{k}" for k in range(DIRECTIONS))).alias("ring"))


def _inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies well inside the polygon of ``ring``: left of all its edges, those of no length left out."""

    def left_of(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        turn = dx * (y - a["y"]) - dy * (x - a["x"])
        # what rounding could have moved over the edge stays
        slack = 1e-9 * (F.abs(dx) + F.abs(dy)) * (F.abs(x - a["x"]) + F.abs(y - a["y"]) + F.abs(dx) + F.abs(dy))
        return ((dx == 0) & (dy == 0)) | (turn > slack)

    last = DIRECTIONS - 1
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, last), F.slice(ring, 1, 1)), left_of)
    corners = F.size(F.array_distinct(ring))
    return (corners >= 3) & F.forall(edges, lambda ok: ok)


def convex_hull(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Corners (by, pos, x, y) of the hull of each group.

    Points inside the polygon of a group's outermost points in ``DIRECTIONS`` directions are no corners; they go first, by
    built-in functions. A hull of partial hulls is exact: the points left are reduced per Arrow batch, again per salted
    part, and only the corners left meet in one task.
    """
    by = list(by)
    fields = [f for f in points.schema.fields if f.name in by]
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    by = [f.name for f in fields]
    rows = points.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    rings = _outermost(rows, by)
    rows = rows.join(rings, by).filter(~_inside(F.col("ring"), F.col("x"), F.col("y"))).select(*by, "x", "y")

    def reduced(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for key, group in frame.groupby(by, dropna=False, sort=False):
            corners = hull_points(group[["x", "y"]].to_numpy())
            part = pd.DataFrame(corners, columns=["x", "y"])
            for name, value in zip(by, key):
                part.insert(0, name, value)
            parts.append(part[[*by, "x", "y"]])
        return pd.concat(parts) if parts else frame

    def per_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield reduced(frame)

    schema = f"{keys}, x double, y double"
    small = rows.mapInPandas(per_batch, schema).withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(SALTS)))
    salted = small.groupBy(*by, "_salt").applyInPandas(lambda f: reduced(f[[*by, "x", "y"]]), schema)

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        whole = reduced(frame)
        whole.insert(len(by), "pos", np.arange(len(whole), dtype="int64"))
        return whole

    return salted.groupBy(*by).applyInPandas(last, f"{keys}, pos bigint, x double, y double")
