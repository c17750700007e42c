"""Connected components of an edge table by alternating stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage, drop_table


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end, without loops."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.filter("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    larger = both.filter("b > a").join(least, "a")
    return _downward(larger.select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _downward(moved.union(least.select("a", F.col("least").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all nodes but the roots.

    ``edges`` has the columns ``a`` and ``b``; loops and repeats do no harm. Rounds go on until the edges are
    the same as in the round before; then each links a node to its root.
    """
    at = cut_lineage(_downward(edges))
    mark = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        stepped = cut_lineage(_small_star(_large_star(at)))
        drop_table(at)
        at, last = stepped, mark
        mark = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
