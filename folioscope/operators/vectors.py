"""Operators over dense document vectors: dimension statistics, scaling, active dimensions, nearest documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vectors as V
from folioscope.session import cut_lineage

Metric = Callable[[Column, Column], Column]

#: Rows of a tile of a table that all rows meet, tiles that are sent to every task, and tasks that share a tile beyond.
TILE_ROWS, SENT_TILES, SALTS = 2000, 8, 32


def dimension_rows(docs: DataFrame, key: str = "doc_id", vector: str = "vector") -> DataFrame:
    """Long form: one row per document and dimension, dimensions counted from 0."""
    return docs.select(key, F.posexplode(vector).alias("dim", "value"))


def dimension_range(docs: DataFrame, vector: str = "vector") -> DataFrame:
    """Least and greatest value and their difference per dimension. Partial sums leave d rows per task."""
    rows = docs.select(F.posexplode(vector).alias("dim", "value"))
    return rows.groupBy("dim").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("value") - F.min("value")).alias("difference")
    )


def _by_dimension(stats: DataFrame, *columns: str) -> Column:
    """The per-dimension table as one array in dimension order, as a scalar: d entries, whatever the corpus."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", *columns)))
    return stats.agg(ordered.alias("stats")).scalar()


def minmax_per_dim(docs: DataFrame, vector: str = "vector", out: str = "vector") -> DataFrame:
    """Scale every dimension to [0, 1] over all documents; a constant dimension gives nulls."""
    stats = _by_dimension(dimension_range(docs, vector), "lo", "difference")
    scaled = F.zip_with(vector, "_stats", lambda x, s: (x - s["lo"]) / F.nullif(s["difference"], F.lit(0.0)))
    return docs.withColumn("_stats", stats).withColumn(out, scaled).drop("_stats")


def l2_normalize(docs: DataFrame, vector: str = "vector", out: str = "vector") -> DataFrame:
    return docs.withColumn(out, V.unit(F.col(vector)))


def l2_per_dim(docs: DataFrame, vector: str = "vector", out: str = "vector") -> DataFrame:
    """Scale every dimension to unit length over all documents."""
    rows = docs.select(F.posexplode(vector).alias("dim", "value"))
    stats = rows.groupBy("dim").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    scaled = F.zip_with(vector, "_stats", lambda x, s: x / F.nullif(s["length"], F.lit(0.0)))
    return docs.withColumn("_stats", _by_dimension(stats, "length")).withColumn(out, scaled).drop("_stats")


def active_dimensions(docs: DataFrame, n: int = 50, vector: str = "vector") -> DataFrame:
    """The ``n`` dimensions of largest range, ties to the lower dimension."""
    return dimension_range(docs, vector).orderBy(F.col("difference").desc(), "dim").limit(n).select("dim")


def active_dims(docs: DataFrame, n: int = 50, vector: str = "vector", out: str = "active") -> DataFrame:
    """Keep the active dimensions of every vector, in their original order."""
    chosen = active_dimensions(docs, n, vector).agg(F.sort_array(F.collect_list("dim"))).scalar()
    kept = F.transform("_dims", lambda d: F.get(F.col(vector), d))
    return docs.withColumn("_dims", chosen).withColumn(out, kept).drop("_dims")


def nearest_docs(docs: DataFrame, query: Column, k: int, key: str = "doc_id", vector: str = "vector") -> DataFrame:
    """The ``k`` documents most similar to one vector: a top-k that keeps k rows per task."""
    paired = docs.select(key, F.col(vector).alias("_v"), query.alias("_q"))
    ranked = paired.select(key, V.cosine(F.col("_v"), F.col("_q")).alias("sim"))
    return ranked.orderBy(F.col("sim").desc(), key).limit(k)


def against(rows: DataFrame, table: DataFrame, *columns: str, tile_rows: int | None = None) -> tuple[DataFrame, int]:
    """Every row of ``rows`` with each tile of ``table``, an array ``_all`` of structs of ``columns``; and the number of tiles.

    A tile has ``tile_rows`` rows at most, and a row of ``rows`` comes once for each tile, so what is taken from
    ``_all`` is to be put together over the tiles. A few tiles are sent to all tasks; of more, each meets the rows in several
    tasks. Nothing is left out, whatever the size of the table.
    """
    tile_rows = tile_rows or TILE_ROWS
    # written, so that the numbers below are the same if a task runs again
    table = cut_lineage(table.select(*columns))
    tiles = max(1, -(-table.count() // tile_rows))
    dealt = table.withColumn("_tile", F.pmod(F.monotonically_increasing_id(), F.lit(tiles)))
    packed = dealt.groupBy("_tile").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_all"))
    spread = rows.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>")))
    if tiles <= SENT_TILES:
        return spread.join(F.broadcast(packed), "_tile").drop("_tile"), tiles
    salted = spread.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["_tile", "_salt"]).drop("_tile", "_salt"), tiles


def pairwise_distance(
    points: DataFrame, metric: Metric, key: str = "point_id", vector: str = "vector", tile_rows: int | None = None
) -> DataFrame:
    """Distances (i, j, distance), i < j, between all rows of a table such as cluster centres, tile by tile.

    The result grows with the square of the table; document tables go through ``cosine_pairs``.
    """
    rows = points.select(F.col(key).alias("i"), F.col(vector).alias("_v"))
    met, _ = against(rows, points, key, vector, tile_rows=tile_rows)
    spread = met.select("i", "_v", F.explode(F.filter("_all", lambda o: o[key] > F.col("i"))).alias("o"))
    return spread.select("i", F.col(f"o.{key}").alias("j"), metric(F.col("_v"), F.col(f"o.{vector}")).alias("distance"))
