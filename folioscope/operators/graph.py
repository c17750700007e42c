"""Citation edges, similarity-edge pruning, undirected edge sets, cluster levels and modularity."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

BUCKETS = 1024


def citation_edges(docs: DataFrame, key: str = "doc_id", refs: str = "refs") -> DataFrame:
    """One row per reference, repeats kept."""
    return docs.select(F.col(key).alias("src"), F.explode(refs).alias("dst"))


def refs_in_corpus(edges: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """References that resolve to a document of the corpus."""
    return edges.join(ids.select(F.col(key).alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def cited_by_reverse(edges: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each reference inside the corpus, the cited document and the citing one; repeats are kept.

    The long form holds any number of citations per document; ``citation_lists`` packs it into arrays.
    """
    inside = refs_in_corpus(edges, ids, key)
    return inside.select(F.col("dst").alias(key), F.col("src").alias("cited_by"))


def _between(edges: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """References from a document of the corpus to one, repeats kept."""
    return refs_in_corpus(edges, corpus, key).join(corpus.select(F.col(key).alias("src")), "src", "left_semi")


def citations_in_corpus(edges: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of citations of every document, from documents of the corpus, 0 when there is none."""
    corpus = ids.select(key).distinct()
    counts = _between(edges, corpus, key).groupBy(F.col("dst").alias(key)).agg(F.count(F.lit(1)).alias("n_citations"))
    return corpus.join(counts, key, "left").select(key, F.coalesce("n_citations", F.lit(0)).alias("n_citations"))


def citing_documents(edges: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The citing documents of the corpus as one array per document, in their order, repeats kept, empty when there is none."""
    corpus = ids.select(key).distinct()
    lists = _between(edges, corpus, key).groupBy(F.col("dst").alias(key)).agg(F.sort_array(F.collect_list("src")).alias("citations"))
    none = F.array().cast(lists.schema["citations"].dataType)
    return corpus.join(lists, key, "left").select(key, F.coalesce("citations", none).alias("citations"))


def citation_lists(reverse: DataFrame, key: str = "doc_id", size: int = 10_000) -> DataFrame:
    """Citing ids as arrays of about ``size`` entries: a much-cited document gets several rows."""
    counts = reverse.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    chunk = F.pmod(F.xxhash64("cited_by"), F.ceil(F.col("_n") / size))
    return (
        reverse.join(counts, key)
        .groupBy(key, chunk.alias("chunk"))
        .agg(F.sort_array(F.collect_list("cited_by")).alias("citations"))
    )


def keep_top_edges(
    edges: DataFrame, bound: Callable[[Column], Column], src: str = "src", sim: str = "sim"
) -> DataFrame:
    """Per source keep the edges at least as similar as its k-th best, ties kept.

    ``bound`` gives k from the number of edges of the source; k = 0, or k beyond that number, keeps all.
    The k-th value is found by counting: first per similarity bucket, then per distinct value inside the
    one bucket that holds it. A source with very many edges is pre-aggregated twice and never sorted whole. The edges are
    read several times, so they are written once.
    """
    edges = cut_lineage(edges)
    ranges = edges.agg(F.min(sim).alias("lo"), F.max(sim).alias("hi"))
    width = ranges.select(F.nullif((F.col("hi") - F.col("lo")), F.lit(0.0))).scalar()
    low = ranges.select("lo").scalar()
    place = F.coalesce(F.floor((F.col(sim) - low) / width * (BUCKETS - 1)), F.lit(0))
    bucketed = edges.select(src, sim, place.alias("bucket"))
    per_bucket = bucketed.groupBy(src, "bucket").agg(F.count(F.lit(1)).alias("n"))
    best_first = Window.partitionBy(src).orderBy(F.col("bucket").desc())
    running = (
        per_bucket.withColumn("upto", F.sum("n").over(best_first.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("k", bound(F.sum("n").over(Window.partitionBy(src))).cast("bigint"))
        .filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
    )
    holding = running.select(src, "bucket", "k", (F.col("upto") - F.col("n")).alias("above"))
    values = (
        bucketed.join(holding, [src, "bucket"])
        .groupBy(src, sim, "k", "above")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    value_order = Window.partitionBy(src).orderBy(F.col(sim).desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = values.withColumn("upto", F.col("above") + F.sum("m").over(value_order)).filter(
        (F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("m") < F.col("k"))
    )
    cuts = reached.select(src, F.col(sim).alias("_cut"))
    kept = edges.join(cuts, src, "left").filter(F.col("_cut").isNull() | (F.col(sim) >= F.col("_cut")))
    return kept.drop("_cut")


def top_edges_fraction(edges: DataFrame, n_docs: DataFrame, share: float = 0.1) -> DataFrame:
    """Per source keep the top ``int(share * (n - 1))`` edges of a corpus of n documents; self edges go first."""
    k = F.floor(F.lit(share) * (n_docs.scalar() - 1))
    return keep_top_edges(edges.filter((F.col("src") != F.col("dst")) & (F.col("sim") > 0)), lambda _: k)


def graph_degree(edges: DataFrame) -> DataFrame:
    """Number of edges per source."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def top_edges_sqrt_degree(edges: DataFrame) -> DataFrame:
    """Per source keep the top ``int(sqrt(degree)) + 1`` positive edges, ties kept."""
    positive = edges.filter(F.col("sim") > 0)
    return keep_top_edges(positive, lambda degree: F.floor(F.sqrt(degree.cast("double"))) + 1)


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges, source < target: the forward weight if there is one, else the reverse one."""
    forward = F.col("src") < F.col("dst")
    pairs = edges.filter((F.col("src") != F.col("dst")) & (F.col("sim") > 0)).select(
        F.least("src", "dst").alias("source"),
        F.greatest("src", "dst").alias("target"),
        F.when(forward, F.col("sim")).alias("fwd"),
        F.when(~forward, F.col("sim")).alias("rev"),
    )
    return pairs.groupBy("source", "target").agg(F.coalesce(F.max("fwd"), F.max("rev")).alias("weight"))


def modularity(edges: DataFrame, membership: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Modularity of a partition of an undirected weighted graph (source, target, weight), one row per level.

    Weighted degrees are summed per node before the cluster is joined, so a hub arrives as one row.
    """
    by = list(by)
    total = edges.agg(F.sum("weight").alias("m")).scalar()
    ends = edges.select(F.col("source").alias("node"), "weight").unionByName(
        edges.select(F.col("target").alias("node"), "weight")
    )
    degree = ends.groupBy("node").agg(F.sum("weight").alias("degree"))
    per_cluster = (
        degree.join(membership, "node").groupBy(*by, "cluster_id").agg(F.sum("degree").alias("degree"))
    )
    # a node's clusters on all levels come as one row, so that an edge is not repeated for each
    place = F.struct(*by, "cluster_id")
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*by, "cluster_id"]])
    packed = membership.filter(known).groupBy("node").agg(F.collect_list(place).alias("places"))
    left = packed.select(F.col("node").alias("source"), F.col("places").alias("left"))
    right = packed.select(F.col("node").alias("target"), F.col("places").alias("right"))
    joined = edges.join(left, "source").join(right, "target")
    shared = F.flatten(F.transform("left", lambda a: F.filter("right", lambda b: a == b)))
    inside = (
        joined.select("weight", F.explode(shared).alias("place"))
        .groupBy(*[F.col(f"place.{c}").alias(c) for c in [*by, "cluster_id"]])
        .agg(F.sum("weight").alias("inside"))
    )
    share = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)
    rows = per_cluster.join(inside, [*by, "cluster_id"], "left").withColumn("m", total)
    return rows.groupBy(*by).agg(F.sum(share).alias("modularity"), F.count(F.lit(1)).alias("n_clusters"))


def best_level(levels: DataFrame) -> DataFrame:
    """The level of highest modularity, ties to the lower level."""
    return levels.orderBy(F.col("modularity").desc(), "level").limit(1)


def first_members(membership: DataFrame, key: str = "doc_id") -> DataFrame:
    """First member of each cluster per level."""
    return membership.groupBy("level", "cluster_id").agg(F.min(key).alias("first"))


def level_map(membership: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each cluster of the finest level with the cluster of its first member on every other level."""
    first = first_members(membership.filter(F.col("level") == 0), key).select("cluster_id", "first")
    others = membership.filter(F.col("level") > 0).select(
        F.col(key).alias("first"), "level", F.col("cluster_id").alias("other_id")
    )
    return first.join(others, "first").select("cluster_id", "level", "other_id")


def cluster_sub_id(membership: DataFrame, top_level: int, key: str = "doc_id") -> DataFrame:
    """Per level and cluster: its top cluster and its number inside it, by order of the first member."""
    first = first_members(membership, key)
    top = membership.filter(F.col("level") == top_level).select(
        F.col(key).alias("first"), F.col("cluster_id").alias("top_id")
    )
    order = Window.partitionBy("level", "top_id").orderBy("first")
    return first.join(top, "first").select(
        "level", "cluster_id", "top_id", (F.row_number().over(order) - 1).cast("bigint").alias("sub_id")
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
