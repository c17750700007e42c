"""Shards of nearly equal bytes for indivisible groups, by Karmarkar-Karp differencing.

A partial partition holds one sum for each shard. Differencing starts with one partial partition for each
item, and again and again joins the two of the largest spread, one in descending and one in ascending order,
so that large sums meet small ones. Groups larger than a small share of a shard are items of their own; the
others are bundled by a hash into items of about that share. So the items are a few hundred for each shard at
most, whatever the number of groups, and one task differences them; only counts and sums of groups are
shuffled for it. Bundles as small as these leave differencing as much room as single groups would.

Groups are equal texts; a null text counts as the empty one. A group is never split, however large. The size
of a row is its text's UTF-8 bytes plus 8. Repeated rows are rows of their own. Fewer groups than shards
leave shards empty; no rows give no rows. Other columns are not returned.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

#: Bundles that make up a shard; there are at most as many larger groups, so items are twice this at most.
BUNDLES = 256
ROW_OVERHEAD = 8
ROW_BITS = 33


def difference(sums: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp: the shard of each subset of each partial partition (both n x k)."""
    n, k = sums.shape
    if not n:
        return np.empty((0, k), np.int32)
    parent: list[int] = [-1] * (n * k)
    heap = []
    for i, row in enumerate(sums.tolist()):
        order = sorted(range(k), key=lambda j: (-row[j], j))
        ordered = [row[j] for j in order]
        heap.append((ordered[-1] - ordered[0], i, ordered, [i * k + j for j in order]))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, a_subsets = heapq.heappop(heap)
        _, _, b, b_subsets = heapq.heappop(heap)
        joined = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(range(k), key=lambda j: (-joined[j], j))
        base = made * k
        parent.extend([-1] * k)
        for j in range(k):
            parent[a_subsets[j]] = parent[b_subsets[k - 1 - j]] = base + j
        ordered = [joined[j] for j in order]
        heapq.heappush(heap, (ordered[-1] - ordered[0], made, ordered, [base + j for j in order]))
        made += 1
    label = np.empty(made * k, np.int32)
    label[heap[0][3]] = np.arange(k)
    for subset in range(len(parent) - 1, -1, -1):
        if parent[subset] >= 0:
            label[subset] = label[parent[subset]]
    return label[: n * k].reshape(n, k)


def _placed(shards: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["weight", "item"], ascending=[False, True], ignore_index=True)
        sums = np.zeros((len(items), shards), np.int64)
        sums[:, 0] = items["weight"]
        return pd.DataFrame({"item": items["item"], "shard": difference(sums)[:, 0]})

    return run


def shard_of_groups(groups: DataFrame, shards: int, bundles: int = BUNDLES) -> DataFrame:
    """The ``shard`` of every ``digest``, from ``groups`` with a ``weight`` each."""
    groups = cut_lineage(groups)
    total = groups.agg(F.sum("weight")).first()[0] or 0
    share = max(1, -(-total // (shards * bundles)))
    bundle = F.pmod(F.xxhash64("digest"), F.lit(shards * bundles)).cast("string")
    named = groups.withColumn("item", F.when(F.col("weight") >= share, F.hex("digest")).otherwise(bundle))
    items = named.groupBy("item").agg(F.sum("weight").alias("weight"))
    placed = items.groupBy().applyInPandas(_placed(shards), "item string, shard int")
    return named.join(F.broadcast(placed), "item").select("digest", "shard")


def shard_rows(
    df: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text", bundles: int = BUNDLES
) -> DataFrame:
    """Every row's size, checksum, ``shard`` and its gapless ``slot`` in the shard.

    A slot is the count of the shard's rows in earlier parts of the scan plus the place among those in the
    row's own part, so no task numbers a whole shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut_lineage(
        df.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.unhex(F.sha2(body, 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("weight"))
    placed = cut_lineage(
        rows.join(shard_of_groups(groups, shards, bundles), "digest").select(
            "doc_id", "size", "text_crc32", "shard", "row", F.shiftright("row", ROW_BITS).alias("source_part")
        )
    )
    counts = placed.groupBy("shard", "source_part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("source_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "source_part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "source_part").orderBy("row")
    numbered = placed.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "source_part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).alias("slot")
    )
