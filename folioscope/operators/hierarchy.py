"""Ward clusters of a large corpus at several level sizes, by way of micro-clusters.

Up to ``HELD_MICRO`` micro-clusters are merged on the driver. More are merged on Spark in rounds: every cluster looks for its
nearest one, tile by tile, and all pairs that are each other's nearest merge at once. As a merge never comes nearer to a
third cluster than its parts were, the pairs are those that one merge after the other would find; ordered by
distance they are the same tree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.clusters import mean_vector
from folioscope.operators.ordering import global_rank
from folioscope.session import cut_lineage

#: Micro-clusters that the driver merges, and rows of a tile where more are merged on Spark.
HELD_MICRO, TILE_ROWS = 2000, 1000


def micro_clusters(docs: DataFrame, m: int, key: str = "doc_id", vector: str = "vector", seed: int = 0) -> DataFrame:
    """Assign every document to one of at most ``m`` micro-clusters: (key, micro, vector)."""
    if m < 1:
        raise ValueError(f"1 micro-cluster or more, not {m}")
    rows = docs.select(key, vector, array_to_vector(vector).alias("features"))
    model = KMeans(k=m, seed=seed, maxIter=20, predictionCol="micro").fit(rows)
    return model.transform(rows).select(key, "micro", vector)


def ward_merges(means: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merge table (a, b, distance, size) of a small table of cluster means; merge s makes cluster n + s.

    Ward distance between means: d * sqrt(2ab / (a + b)).
    """
    means, sizes = {i: v for i, v in enumerate(means)}, {i: float(s) for i, s in enumerate(sizes)}
    merges, fresh = [], len(means)
    while len(means) > 1:
        ids = np.array(sorted(means))
        points = np.stack([means[i] for i in ids])
        weight = np.array([sizes[i] for i in ids])
        gaps = np.maximum(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2), 0)
        cost = np.sqrt(gaps * 2 * weight[:, None] * weight[None, :] / (weight[:, None] + weight[None, :]))
        cost[np.tril_indices(len(ids))] = np.inf
        at, to = np.unravel_index(np.argmin(cost), cost.shape)
        a, b = int(ids[at]), int(ids[to])
        size = sizes[a] + sizes[b]
        merges.append((a, b, float(cost[at, to]), int(size)))
        means[fresh] = (means.pop(a) * sizes[a] + means.pop(b) * sizes[b]) / size
        sizes[fresh] = size
        fresh += 1
    return merges


def cut(merges: Sequence[tuple[int, int, float, int]], n: int, size: int) -> list[int]:
    """Cluster of each of the ``n`` starting clusters once ``size`` are left, numbered by first member."""
    parent = list(range(n + len(merges)))
    for step, (a, b, _, _) in enumerate(merges[: max(0, n - size)]):
        parent[a] = parent[b] = n + step

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    numbers: dict[int, int] = {}
    return [numbers.setdefault(root(i), len(numbers)) for i in range(n)]


def _ward(points: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Ward distances of some points to others."""
    gaps = ((points[:, None, :] - others[None, :, :]) ** 2).sum(axis=2)
    return np.sqrt(gaps * 2 * sizes[:, None] * other_sizes[None, :] / (sizes[:, None] + other_sizes[None, :]))


def _nearest_in_tiles(table: pa.Table) -> pa.Table:
    """The nearest cluster of the other tile, or of the same one, for every cluster of a pair of tiles; ties to the lower id."""
    table = table.sort_by("id")
    tiles, ids, sizes = (table.column(c).to_numpy() for c in ("tile", "id", "size"))
    lists = table.column("vector").combine_chunks()
    vectors = lists.flatten().to_numpy().reshape(len(ids), -1)
    first, last = table.column("tile_a")[0].as_py(), table.column("tile_b")[0].as_py()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own, other in dict.fromkeys(((first, last), (last, first))):
        rows, to = np.flatnonzero(tiles == own), np.flatnonzero(tiles == other)
        for at in range(0, len(rows) if len(to) else 0, 32):
            part = rows[at : at + 32]
            costs = _ward(vectors[part], sizes[part].astype(float), vectors[to], sizes[to].astype(float))
            costs[ids[part][:, None] == ids[to][None, :]] = np.inf
            best = costs.argmin(axis=1)
            found.append((ids[part], costs[np.arange(len(part)), best], ids[to][best]))
    columns = [np.concatenate([f[k] for f in found]) if found else np.empty(0) for k in range(3)]
    kept = np.isfinite(columns[1].astype(float))
    return pa.table({"id": columns[0][kept].astype(np.int64), "d": columns[1][kept].astype(float), "other": columns[2][kept].astype(np.int64)})


def nearest_clusters(clusters: DataFrame, n: int, tile_rows: int | None = None) -> DataFrame:
    """``id, d, other``: the nearest of all other clusters (``id, size, vector``) by Ward distance, ties to the lower id."""
    tiles = max(1, -(-n // (tile_rows or TILE_ROWS)))
    tiled = clusters.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"))
    dealt = tiled.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        F.least("tile", "met").alias("tile_a"), F.greatest("tile", "met").alias("tile_b"), "tile", "id", "size", "vector"
    )
    found = dealt.groupBy("tile_a", "tile_b").applyInArrow(_nearest_in_tiles, "id bigint, d double, other bigint")
    best = found.groupBy("id").agg(F.min(F.struct("d", "other")).alias("best"))
    return best.select("id", "best.d", "best.other")


def merge_rounds(clusters: DataFrame, tile_rows: int | None = None) -> DataFrame:
    """All merges (a, b, distance, size, round) of clusters (``id, size, vector``); a merge goes on under the lower id, ``a``."""
    now, turn, parts = cut_lineage(clusters.select(F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size"), "vector")), 0, []
    while (n := now.count()) > 1:
        near = cut_lineage(nearest_clusters(now, n, tile_rows))
        back = near.select(F.col("id").alias("other"), F.col("other").alias("back"))
        pairs = near.join(back, "other").filter((F.col("back") == F.col("id")) & (F.col("id") < F.col("other")))
        left, right = now.toDF("id", "na", "va"), now.toDF("other", "nb", "vb")
        size = F.col("na") + F.col("nb")
        mean = F.zip_with("va", "vb", lambda x, y: (x * F.col("na") + y * F.col("nb")) / (F.col("na") + F.col("nb")))
        merged = cut_lineage(
            pairs.join(left, "id").join(right, "other").select("id", "other", "d", size.alias("size"), mean.alias("vector"))
        )
        parts.append(merged.select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("d").alias("distance"), "size", F.lit(turn).alias("round")))
        gone = merged.select("id").union(merged.select("other"))
        now = cut_lineage(now.join(gone, "id", "left_anti").unionByName(merged.select("id", "size", "vector")))
        turn += 1
    if not parts:
        return clusters.sparkSession.createDataFrame([], "a long, b long, distance double, size long, round int")
    return reduce(DataFrame.unionByName, parts)


def numbered_merges(merges: DataFrame, n: int) -> DataFrame:
    """The merges in order (``step``), with clusters numbered: ``n`` + s is what step s makes, as the driver's table does."""
    order = [F.round("distance", 12), F.col("round"), F.col("a"), F.col("b")]
    ranked = cut_lineage(global_rank(merges, order, "step", start=0))
    before = F.lag("step").over(Window.partitionBy("a").orderBy("step"))
    last = ranked.groupBy(F.col("a").alias("b")).agg(F.max("step").alias("last"))
    told = ranked.withColumn("before", before).join(last, "b", "left")
    return told.select(
        F.col("step").cast("int").alias("step"), F.col("a").alias("low"), F.col("b").alias("high"),
        F.coalesce(F.col("before") + n, "a").cast("int").alias("a"), F.coalesce(F.col("last") + n, "b").cast("int").alias("b"),
        "distance", "size",
    )


def level_labels(steps: DataFrame, ids: DataFrame, n: int, size: int) -> DataFrame:
    """``id, cluster_id`` once ``size`` clusters are left, numbered by first member."""
    parents = steps.filter(F.col("step") < n - size).select(F.col("high").alias("id"), F.col("low").alias("root"))
    known = ids.select("id").join(parents, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    while True:
        known = cut_lineage(known)
        up = known.select(F.col("id").alias("root"), F.col("root").alias("next"))
        stepped = known.join(up, "root").select("id", "root", "next")
        if stepped.filter("next <> root").isEmpty():
            break
        known = stepped.select("id", F.col("next").alias("root"))
    roots = global_rank(known.select("root").distinct(), [F.col("root")], "cluster_id", start=0)
    return known.join(roots, "root").select("id", F.col("cluster_id").cast("int").alias("cluster_id"))


def hierarchical_clusters(
    docs: DataFrame, sizes: Sequence[int], micro: int = 200, key: str = "doc_id", vector: str = "vector", seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Membership (key, level, cluster_id) at the given level sizes and the merge table (step, a, b, distance, size).

    The corpus is reduced to ``micro`` micro-clusters on Spark, whose means and sizes are merged: few on the driver, more in
    rounds on Spark. The labels are joined back to the documents.
    """
    assigned = cut_lineage(micro_clusters(docs, micro, key, vector, seed))
    table = cut_lineage(assigned.groupBy("micro").agg(mean_vector(vector).alias("mean"), F.count(F.lit(1)).alias("size")))
    n = table.count()
    if max(sizes, default=0) > n:
        raise ValueError(f"{max(sizes)} clusters asked of {n} micro-clusters; raise micro")
    spark = docs.sparkSession
    if n > HELD_MICRO:
        ids = cut_lineage(global_rank(table, [F.col("micro")], "id", start=0))
        steps = cut_lineage(numbered_merges(merge_rounds(ids.select("id", "size", F.col("mean").alias("vector"))), n))
        levels = [level_labels(steps, ids, n, size).withColumn("level", F.lit(level)) for level, size in enumerate(sizes)]
        lookup = reduce(DataFrame.unionByName, levels).join(ids.select("id", "micro"), "id").select("micro", "level", "cluster_id")
        return assigned.join(lookup, "micro").select(key, "level", "cluster_id"), steps.drop("low", "high")
    rows = table.orderBy("micro").collect()
    merges = ward_merges(np.array([r["mean"] for r in rows]), np.array([r["size"] for r in rows]))
    labels = [
        (rows[i]["micro"], level, cluster)
        for level, size in enumerate(sizes)
        for i, cluster in enumerate(cut(merges, len(rows), size))
    ]
    lookup = spark.createDataFrame(labels, "micro int, level int, cluster_id int")
    steps = spark.createDataFrame(
        [(s, a, b, d, n) for s, (a, b, d, n) in enumerate(merges)],
        "step int, a int, b int, distance double, size bigint",
    )
    return assigned.join(lookup, "micro").select(key, "level", "cluster_id"), steps
