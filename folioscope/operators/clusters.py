"""Clusters of documents: summaries, similarity, silhouettes, linkage, separation of layouts, k-means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vectors as V
from folioscope.operators.ordering import global_rank
from folioscope.operators.vectors import Metric, against
from folioscope.session import cut_lineage

# centres up to which k-means keeps them on the driver; more are a table
HELD_CENTRES = 5000


def mean_vector(vector: str) -> Column:
    """Mean of a vector column as an aggregate, with partial sums and no exploded rows."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vector))))


def cluster_summary(
    docs: DataFrame, membership: DataFrame, vectors: Sequence[str] = ("vector",), key: str = "doc_id"
) -> DataFrame:
    """Per level and cluster: size, centre of the layout, mean vectors and mean silhouette."""
    joined = membership.select(key, "level", "cluster_id").join(docs, key)
    columns = [F.count(F.lit(1)).alias("size"), F.avg("x").alias("center_x"), F.avg("y").alias("center_y")]
    if "silhouette" in docs.columns:
        columns.append(F.avg("silhouette").alias("silhouette"))
    columns += [mean_vector(v).alias(v) for v in vectors]
    return joined.groupBy("level", "cluster_id").agg(*columns)


def cluster_highlights(
    membership: DataFrame, relevant: DataFrame, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """Number of relevant members per level and cluster, and those members in long form."""
    marked = membership.join(
        relevant.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left"
    ).select(key, "level", "cluster_id", F.coalesce("_hit", F.lit(False)).alias("relevant"))
    counts = marked.groupBy("level", "cluster_id").agg(F.count_if("relevant").alias("n_relevant"))
    return counts, marked.filter("relevant").select("level", "cluster_id", key)


def cluster_similarity(clusters: DataFrame, vector: str = "vector", tile_rows: int | None = None) -> DataFrame:
    """Cosine between the mean vectors of all clusters of a level; 1 on the diagonal."""
    rows = clusters.select("level", F.col("cluster_id").alias("i"), F.col(vector).alias("_v"))
    met, _ = against(rows, clusters, "level", "cluster_id", vector, tile_rows=tile_rows)
    same = F.explode(F.filter("_all", lambda o: o["level"] == F.col("level")))
    pairs = met.select("level", "i", "_v", same.alias("o"))
    sim = F.when(F.col("i") == F.col("o.cluster_id"), F.lit(1.0)).otherwise(
        V.cosine(F.col("_v"), F.col(f"o.{vector}"))
    )
    return pairs.select("level", "i", F.col("o.cluster_id").alias("j"), sim.alias("sim"))


def silhouette(
    docs: DataFrame, membership: DataFrame, key: str = "doc_id", vector: str = "vector", tile_rows: int | None = None
) -> DataFrame:
    """Silhouette of every document per level, over squared Euclidean distances.

    The mean squared distance to a cluster follows from its size, mean vector and mean squared length, so
    one pass over the documents replaces the comparison of all pairs. A single-member cluster gives 0. Of a
    table of clusters in several tiles, the nearest of each tile are put together per document.
    """
    joined = membership.select(key, "level", "cluster_id").join(docs.select(key, vector), key)
    squared = joined.withColumn("_sq", V.dot(F.col(vector), F.col(vector)))
    stats = squared.groupBy("level", "cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.avg("_sq").alias("mean_sq"), mean_vector(vector).alias("mean")
    )
    rows, tiles = against(squared, stats, "level", "cluster_id", "size", "mean_sq", "mean", tile_rows=tile_rows)
    distance = F.transform(
        F.filter("_all", lambda c: c["level"] == F.col("level")),
        lambda c: F.struct(
            (c["cluster_id"] == F.col("cluster_id")).alias("own"),
            c["size"].alias("size"),
            (F.col("_sq") - 2 * V.dot(F.col(vector), c["mean"]) + c["mean_sq"]).alias("d"),
        ),
    )
    spread = rows.select(key, "level", "cluster_id", distance.alias("_d"))
    own = F.get(F.filter("_d", lambda c: c["own"]), F.lit(0))
    other = F.array_min(F.transform(F.filter("_d", lambda c: ~c["own"]), lambda c: c["d"]))
    near = spread.select(key, "level", "cluster_id", own.alias("_own"), other.alias("_b"))
    if tiles > 1:
        near = near.groupBy(key, "level", "cluster_id").agg(F.max("_own").alias("_own"), F.min("_b").alias("_b"))
    near = near.withColumn("_a", F.col("_own.d") * F.col("_own.size") / F.nullif(F.col("_own.size") - 1, F.lit(0)))
    value = (F.col("_b") - F.col("_a")) / F.nullif(F.greatest("_a", "_b"), F.lit(0.0))
    return near.select(key, "level", "cluster_id", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def cluster_separation(
    layout: DataFrame, membership: DataFrame, rates: Sequence[float] = (1.0, 2.0), key: str = "doc_id"
) -> DataFrame:
    """Move every point away from the centre of the map by rate x (centre of its cluster - centre).

    Cluster centres are aggregated and joined back; the clusters of a level are a small table.
    """
    centre = layout.agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y"))).scalar()
    joined = membership.select(key, "level", "cluster_id").join(layout.select(key, "x", "y"), key)
    centres = joined.groupBy("level", "cluster_id").agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    moved = joined.join(centres, ["level", "cluster_id"]).withColumn("_g", centre)
    moved = moved.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return moved.select(
        key,
        "level",
        "rate",
        (F.col("x") + F.col("rate") * (F.col("_cx") - F.col("_g.x"))).alias("x"),
        (F.col("y") + F.col("rate") * (F.col("_cy") - F.col("_g.y"))).alias("y"),
    )


def graph_center(layout: DataFrame) -> DataFrame:
    return layout.agg(F.avg("x").alias("center_x"), F.avg("y").alias("center_y"))


LINKAGES = ("single", "complete", "average", "centroid", "ward")


def cluster_linkage(
    points: DataFrame,
    method: str,
    metric: Metric = V.euclidean,
    cluster: str = "cluster_id",
    vector: str = "vector",
    tile_rows: int | None = None,
) -> DataFrame:
    """Distance (a, b, distance), a < b, between clusters of points.

    Centroid and Ward linkage need the cluster means only. Single, complete and average linkage compare
    the points themselves, tile by tile; each tile gives the least, greatest or summed distance per pair of clusters.
    """
    if method not in LINKAGES:
        raise ValueError(f"linkage {method!r} is none of {LINKAGES}")
    if method in ("centroid", "ward"):
        members = points.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), mean_vector(vector).alias(vector))
    else:
        members = points.select(cluster, F.lit(1).alias("size"), vector)
    rows = members.select(F.col(cluster).alias("a"), F.col("size").alias("_n"), F.col(vector).alias("_v"))
    met, _ = against(rows, members, cluster, "size", vector, tile_rows=tile_rows)
    others = F.explode(F.filter("_all", lambda o: o[cluster] > F.col("a")))
    pairs = met.select("a", "_n", "_v", others.alias("o"))
    between = pairs.select(
        "a",
        F.col(f"o.{cluster}").alias("b"),
        metric(F.col("_v"), F.col(f"o.{vector}")).alias("d"),
        F.col("_n").alias("na"),
        F.col("o.size").alias("nb"),
    )
    if method == "centroid":
        return between.select("a", "b", F.col("d").alias("distance"))
    if method == "ward":
        grown = F.col("d") * F.sqrt(2.0 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
        return between.select("a", "b", grown.alias("distance"))
    pick = {"single": F.min, "complete": F.max, "average": F.avg}[method]
    return between.groupBy("a", "b").agg(pick("d").alias("distance"))


def merge_step(points: DataFrame, method: str = "ward", cluster: str = "cluster_id", vector: str = "vector") -> DataFrame:
    """The closest pair of clusters and what they become: one row (a, b, distance, size, vector)."""
    closest = cluster_linkage(points, method, cluster=cluster, vector=vector).orderBy("distance", "a", "b").limit(1)
    pair = closest.withColumn(cluster, F.explode(F.array("a", "b")))
    return (
        points.join(pair, cluster)
        .groupBy("a", "b", "distance")
        .agg(F.count(F.lit(1)).alias("size"), mean_vector(vector).alias(vector))
    )


def kmeans_assign(
    docs: DataFrame, centres: DataFrame, key: str = "doc_id", vector: str = "vector", tile_rows: int | None = None
) -> DataFrame:
    """Nearest centre of every document, ties to the lower label. The centres reach the tasks in tiles."""
    rows, tiles = against(docs.select(key, vector), centres.select("label", F.col("vector").alias("_centre")), "label", "_centre", tile_rows=tile_rows)
    nearest = F.array_min(
        F.transform(
            "_all",
            lambda c: F.struct(
                V.squared_euclidean(F.col(vector), c["_centre"]).alias("d"), c["label"].alias("label")
            ),
        )
    )
    found = rows.select(key, vector, nearest.alias("_best"))
    if tiles > 1:
        found = found.groupBy(key, vector).agg(F.min("_best").alias("_best"))
    return found.select(key, vector, F.col("_best.label").alias("label"))


def kmeans_update(
    assigned: DataFrame, centres: DataFrame, vector: str = "vector"
) -> DataFrame:
    """Mean of the members per label; a centre without members stays."""
    means = assigned.groupBy("label").agg(mean_vector(vector).alias("_mean"))
    joined = centres.select("label", F.col("vector").alias("_old")).join(means, "label", "left")
    return joined.select("label", F.coalesce("_mean", "_old").alias("vector"))


def _labels(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    # an Arrow batch of documents against all centres at once
    gaps = ((points**2).sum(axis=1))[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None, :]
    return gaps.argmin(axis=1)


def _nearest(centres: np.ndarray):
    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(_labels(np.stack(vectors.to_numpy()), centres).astype("int32"))

    return nearest


def _sums_step(centres: np.ndarray):
    """The sum and the number of a task's vectors nearest to each centre; the vectors themselves do not come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros_like(centres, dtype=float), np.zeros(len(centres), np.int64)
        for batch in batches:
            if batch.num_rows:
                points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                labels = _labels(points, centres)
                order = np.argsort(labels, kind="stable")
                found, starts, counts = np.unique(labels[order], return_index=True, return_counts=True)
                sums[found] += np.add.reduceat(points[order], starts, axis=0)
                sizes[found] += counts
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_pydict(
            {
                "label": pa.array(used.astype(np.int32)),
                "n": pa.array(sizes[used]),
                "sums": pa.array(list(sums[used]), pa.list_(pa.float64())),
            }
        )

    return run


def kmeans(
    docs: DataFrame, k: int | None = None, iterations: int = 1000, key: str = "doc_id", vector: str = "vector"
) -> tuple[DataFrame, DataFrame]:
    """Lloyd's iterations from the first ``k`` documents; k defaults to round(sqrt(n / 2)).

    Up to ``HELD_CENTRES`` centres are held on the driver; more are a table, met in tiles. Every iteration is one pass with
    partial sums per task, and the iterations end early once no centre moves. Returns (key, label) and the centres
    (label, vector, size).
    """
    # dealt to all cores, also where the table is a single row group
    parts = docs.sparkSession.sparkContext.defaultParallelism
    data = cut_lineage(docs.select(key, V.as_doubles(F.col(vector)).alias(vector)).repartition(parts, key))
    if k is None:
        k = max(1, round((data.count() / 2) ** 0.5))
    if k > HELD_CENTRES:
        return _kmeans_tables(data, k, iterations, key, vector)
    centres = np.array([row[0] for row in data.orderBy(key).limit(k).select(vector).collect()])
    for _ in range(iterations):
        partial = data.select(vector).mapInArrow(_sums_step(centres), "label int, n bigint, sums array<double>")
        summed = Summarizer.metrics("sum").summary(array_to_vector("sums"))["sum"]
        means = partial.groupBy("label").agg(F.sum("n").alias("n"), vector_to_array(summed).alias("sums")).collect()
        moved = centres.copy()
        for row in means:
            moved[row["label"]] = np.array(row["sums"]) / row["n"]
        settled = np.allclose(moved, centres, rtol=0, atol=1e-12)
        centres = moved
        if settled:
            break
    labels = data.select(key, _nearest(centres)(F.col(vector)).alias("label"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    table = docs.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centres)], "label int, vector array<double>"
    )
    return labels, table.join(sizes, "label", "left").fillna(0, ["size"])


def _kmeans_tables(data: DataFrame, k: int, iterations: int, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """``kmeans`` with the centres as a table, written in each iteration."""
    first = global_rank(data, [F.col(key)], "label", start=0).filter(F.col("label") < k)
    centres = cut_lineage(first.select(F.col("label").cast("int").alias("label"), F.col(vector).alias("vector")))
    for _ in range(iterations):
        moved = cut_lineage(kmeans_update(kmeans_assign(data, centres, key, vector), centres, vector))
        apart = F.exists(F.zip_with("vector", "_old", lambda a, b: F.abs(a - b)), lambda d: d > 1e-12)
        settled = moved.join(centres.select("label", F.col("vector").alias("_old")), "label").filter(apart).isEmpty()
        centres = moved
        if settled:
            break
    labels = kmeans_assign(data, centres, key, vector).select(key, "label")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return labels, centres.join(sizes, "label", "left").fillna(0, ["size"])


def kmeans_1d(df: DataFrame, value: str, order: Sequence[Column], k: int, iterations: int = 1000) -> DataFrame:
    """One-dimensional k-means from systematically sampled starts, until stable; a later centre wins ties.

    Works on distinct values with their counts. Returns (value, label, n) per distinct value.
    """
    rows = df.filter(F.col(value).isNotNull())
    n = rows.count()
    hop = int(n / (k + 1) + 0.5)
    places = [min(hop * (i + 1), n - 1) for i in range(k)]
    ranked = global_rank(rows.select(value, *[c.alias(f"_o{i}") for i, c in enumerate(order)]),
                         [F.col(f"_o{i}") for i in range(len(order))], "_place", start=0)
    starts = {r["_place"]: r[value] for r in ranked.filter(F.col("_place").isin(places)).collect()}
    centres = [float(starts[p]) for p in places]
    counts = cut_lineage(rows.groupBy(F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))

    def labelled() -> DataFrame:
        gaps = [
            F.struct(F.abs(F.col("value") - F.lit(c)).alias("d"), F.lit(-i).alias("later")) for i, c in enumerate(centres)
        ]
        return counts.withColumn("label", -F.array_min(F.array(*gaps))["later"])

    for _ in range(iterations):
        means = labelled().groupBy("label").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("m")).collect()
        moved = list(centres)
        for row in means:
            moved[row["label"]] = row["m"]
        if moved == centres:
            break
        centres = moved
    return labelled()
