"""Statistics of columns: location, spread, correlation, standard scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.ordering import prefix_sum, value_ranks


def stats_basic(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )


def stats_variance(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Sample and population variance and deviation."""
    return df.groupBy(*by).agg(
        F.var_samp(value).alias("var_samp"),
        F.var_pop(value).alias("var_pop"),
        F.stddev_samp(value).alias("dev_samp"),
        F.stddev_pop(value).alias("dev_pop"),
    )


def stats_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median per group.

    Equal values are counted before the shuffle, and the middle is found from the counts by a running
    total per group, so no group is gathered into the buffer of one task.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return _median_of_counts(counts, value, by)


def _median_of_counts(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    order = [F.col(c) for c in [*by, value]]
    running = prefix_sum(counts, order, "n", "upto")
    # ranks are global; a group's first rank is its total subtracted from its last
    groups = running.groupBy(*by).agg(F.max("upto").alias("last"), F.sum("n").alias("size"))
    if by:
        joined = running.join(groups, by)
    else:
        size = groups.select("size").scalar()
        joined = running.withColumn("size", size).withColumn("last", F.col("size"))
    rank = F.col("upto") - (F.col("last") - F.col("size"))
    low, high = F.floor((F.col("size") + 1) / 2), F.floor((F.col("size") + 2) / 2)
    holds = lambda k: (rank >= k) & (rank - F.col("n") < k)
    return joined.groupBy(*by).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2.0).alias("median")
    )


def corr_pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("corr"))


def corr_spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation, ties averaged."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = value_ranks(both, x).select(x, F.col("rank").alias("_rx"))
    ry = value_ranks(both, y).select(y, F.col("rank").alias("_ry"))
    return both.select(x, y).join(rx, x).join(ry, y).agg(F.corr("_rx", "_ry").alias("corr"))


def standard_scores(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Difference from the group mean, and the same over sample and over population deviation.

    The group statistics are aggregated with partial sums and joined back; a window would put a hot
    group into one task.
    """
    by = list(by)
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_samp"), F.stddev_pop(value).alias("_pop")
    )
    deviation = F.col(value) - F.col("_mean")
    return (
        df.join(stats, by)
        .withColumn("deviation", deviation)
        .withColumn("standardized", deviation / F.nullif(F.col("_samp"), F.lit(0.0)))
        .withColumn("zscore", deviation / F.nullif(F.col("_pop"), F.lit(0.0)))
        .drop("_mean", "_samp", "_pop")
    )


def scale_to_max(df: DataFrame, value: str, target: float, by: Sequence[str]) -> DataFrame:
    """Scale values so that the largest of each group becomes ``target``."""
    by = list(by)
    top = df.groupBy(*by).agg(F.max(value).alias("_top"))
    scaled = F.col(value) * (F.lit(target) / F.nullif(F.col("_top"), F.lit(0.0)))
    return df.join(top, by).withColumn("scaled", scaled).drop("_top")


def bounding_box(points: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(
        (F.max(x) - F.min(x)).alias("width"), (F.max(y) - F.min(y)).alias("height")
    )
