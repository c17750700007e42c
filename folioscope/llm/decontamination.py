"""Benchmark decontamination: short items found inside long documents by size-partitioned MinHash.

Texts become shingles of five words (runs of letters and digits, in lower case). An item of n distinct
shingles is contained in a document if at least the share ``threshold`` of them occurs there. Whichever n -
ceil(threshold * n) + 1 shingles of the item are chosen, a document that contains it has one of them; the ones
of least hash value, the item's MinHash sketch, are taken. Items are partitioned by size, in classes that
double, and a class keeps the sketch that its largest member needs, so no contained item is missed. The
sketches meet the hashes of all documents' shingles in one join; documents that share a sketch value with an
item are candidates, and exact comparison of the shingles themselves decides.

A null or empty text, and an item of fewer than five words, has no shingles and is part of no result. Equal
rows of the items count once; equal documents give a row each. An empty table gives an empty result. Other
columns are not returned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shingles import held, joined, plain_words, runs, small_side

WORDS = 5
THRESHOLD = 0.8


def sketch_size(shingles: Column, threshold: float) -> Column:
    """Shingles to keep of an item, as the largest size of its class (one less than a power of two) needs."""
    largest = F.pow(F.lit(2), F.length(F.bin(shingles))) - 1
    return (largest - F.ceil(F.round(largest * threshold, 6)) + 1).cast("int")


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, its distinct ``shingles`` and their number ``n_shingles``; items without any are absent."""
    words = items.select(F.col(item_id).alias("item_id"), plain_words(F.col(text)).alias("words")).distinct()
    cut = words.select("item_id", F.array_distinct(runs(F.col("words"), WORDS, joined)).alias("shingles"))
    return cut.withColumn("n_shingles", F.size("shingles")).filter(F.col("n_shingles") > 0)


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """``value`` for each of the least hash values of an item's shingles, with all that stands for the item."""
    hashed = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(*_parts(s))))
    kept = F.slice(hashed, 1, sketch_size(F.col("n_shingles"), threshold))
    return items.select("item_id", "n_shingles", "shingles", F.explode(kept).alias("value"))


def _parts(shingle: Column) -> list[Column]:
    return [F.get(F.split(shingle, " "), F.lit(k)) for k in range(WORDS)]


def contained(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every document and item it contains: ``doc_id, item_id, n_shingles, n_shared, containment``, ``key``.

    ``key`` is a hash of the document's id and text, by which rows can be found again.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(id_column, text).alias("key")
    )
    listed = item_shingles(items)
    sought = sketches(listed, threshold).select("value", F.struct("item_id", "shingles").alias("item"))
    named = sought.withColumn("item_key", F.xxhash64("item")).drop("item")
    words = rows.select("key", plain_words(F.col("text")).alias("words"))
    values = words.select("key", F.explode(runs(F.col("words"), WORDS, F.xxhash64)).alias("value"))
    met = values.join(small_side(named.distinct()), "value").select("key", "item_key").distinct()
    known = listed.withColumn("item_key", F.xxhash64(F.struct("item_id", "shingles")))
    candidates = met.join(known, "item_key")
    pairs = held(rows.join(candidates, "key"), "words", plain_words(F.col("text")))
    shared = held(pairs, "n_shared", F.size(F.array_intersect("shingles", runs(F.col("words"), WORDS, joined))))
    return shared.filter(F.col("n_shared") >= F.ceil(F.round(F.col("n_shingles") * threshold, 6))).select(
        "doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"), "key"
    )


def without_contaminated(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that contain no item; their columns and rows stay as they are."""
    key, found_id = f"_key_{uuid.uuid4().hex}", f"_id_{uuid.uuid4().hex}"
    found = contained(docs, items, id_column, text, threshold)
    gone = found.select(F.col("key").alias(key), F.col("doc_id").alias(found_id)).distinct()
    same = (F.xxhash64(docs[id_column], docs[text]) == gone[key]) & docs[id_column].eqNullSafe(gone[found_id])
    return docs.join(gone, same, "left_anti")
