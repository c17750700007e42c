"""Global order without a single-partition window: ranks, prefix sums, moving averages.

Rows are range-partitioned on the order columns and materialised once; the per-partition totals, one
row per partition, give every partition its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

ROW_BITS = (1 << 33) - 1


def _partitions(df: DataFrame) -> int:
    """The shuffle width, but no more than four ranges per core: every range becomes a file."""
    session = df.sparkSession
    width = int(session.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(width, 4 * session.sparkContext.defaultParallelism))


def _in_order(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows with their partition ``_part`` and their place in it ``_row``, both following the order.

    The order must be total. The result is materialised, so that later passes see the same partitions.
    """
    ranged = df.repartitionByRange(_partitions(df), *order).sortWithinPartitions(*order)
    return cut_lineage(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn(
            "_row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
        )
    )


def _offsets(rows: DataFrame, total: Column) -> DataFrame:
    """What lies before each partition: one row per partition of ``_in_order``, hence safe to broadcast."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(total.alias("_total"))
    return F.broadcast(totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """Number all rows in a total order."""
    rows = _in_order(df, order)
    ranked = rows.join(_offsets(rows, F.count(F.lit(1))), "_part")
    return ranked.withColumn(name, F.col("_before") + F.col("_row") + start).drop("_part", "_row", "_before")


def prefix_sum(df: DataFrame, order: Sequence[Column], value: str, name: str = "running") -> DataFrame:
    """Running total of ``value`` over all rows in a total order, the row itself included."""
    rows = _in_order(df, order)
    upto = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("_inner", F.sum(value).over(upto))
    summed = inner.join(_offsets(rows, F.sum(value)), "_part")
    return summed.withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_row", "_inner", "_before")


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """Per distinct value its count and its 1-based rank, ties averaged."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("ties"))
    running = prefix_sum(counts, [F.col(value)], "ties", "upto")
    return running.select(value, "ties", (F.col("upto") - (F.col("ties") - 1) / 2.0).alias("rank"))


def rank_avg(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """1-based rank of every row by value, ties averaged. Ties are counted before any ordering."""
    ranks = value_ranks(df, value).select(value, F.col("rank").alias(name))
    return df.join(ranks, value, "left")


def moving_avg(df: DataFrame, order: Sequence[Column], value: str, size: int, block: int = 100_000) -> DataFrame:
    """Mean of the last ``size`` values in a total order; only full windows are emitted.

    Ranked rows are cut into blocks, and each block also receives the last ``size - 1`` rows of the
    block before it, so that every window lies inside one block.
    """
    block = max(block, size)
    ranked = global_rank(df, order, "_rank", start=0)
    home = F.floor(F.col("_rank") / block)
    lead = F.floor((F.col("_rank") + (size - 1)) / block)
    copies = F.when(lead > home, F.array(home, lead)).otherwise(F.array(home))
    spread = ranked.withColumn("_home", home).withColumn("_block", F.explode(copies))
    frame = Window.partitionBy("_block").orderBy("_rank").rowsBetween(-(size - 1), 0)
    averaged = spread.withColumn("moving_avg", F.avg(value).over(frame))
    kept = averaged.filter((F.col("_block") == F.col("_home")) & (F.col("_rank") >= size - 1))
    return kept.drop("_rank", "_home", "_block")
