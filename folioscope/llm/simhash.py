"""Near-duplicates by SimHash: 64-bit fingerprints, linked at a few differing bits, exactly.

A fingerprint bit is set if more than half of the text's shingles have it set in their hash. Texts are
compared by distinct fingerprints, so copies enter once. Two fingerprints that differ in at most two bits
agree in two of their four 16-bit blocks at least; for each pair of blocks those that agree in both form a
bucket. Buckets are compared exactly, in tiles: numpy exclusive-or and bit counts over a tile pair, which is
skipped if the tiles' population counts lie further apart than the radius. A bucket of many fingerprints is
split over tasks by tile pairs. From each bucket only the edges of a spanning forest go on, so a dense group
gives no more edges than members; components join them.

A null text counts as empty. A text without words has fingerprint zero and is linked like any other; one of
fewer words than a shingle has its whole sequence as its only shingle. Texts are used whole. Rows repeat as
they are; null ids stand for nothing in a component's least id, which is null if all of its ids are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.batches import schema_with, through, with_columns
from folioscope.llm.components import components
from folioscope.session import cut_lineage

WORDS, RADIUS, SEED = 3, 2, 42
BLOCK_BITS, BLOCKS = 16, 4
#: Fingerprints of a tile, and of a bucket that is compared in one task.
TILE, BUCKET = 1024, 16_384
#: Buckets up to this size are compared all at once, by shifts.
SMALL = 32
#: Rows a task gathers before it compares them.
GATHERED = 200_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text."""
    return int(_fingerprints([text], words)[0])


def _shingle_hashes(text: str, size: int) -> np.ndarray:
    words = text.encode().lower().split()  # bytes: A-Z only, and white space 09-0D and 20 only
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - size + 1))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        octets = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: list[str], size: int) -> np.ndarray:
    return np.array([_majority(_shingle_hashes(text, size)) for text in texts], np.uint64)


def _fingerprint_step(text: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _fingerprints([t or "" for t in batch.column(text).to_pylist()], words)
            columns = {name: batch.column(name) for name in batch.schema.names if name != text}
            yield pa.RecordBatch.from_pydict(columns | {"fp": pa.array(made.view(np.int64), pa.int64())})

    return run


def with_fingerprints(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``df`` without its text, and with ``fp``: the fingerprint's 64 bits as a long."""
    return through(df, [_fingerprint_step(text, words)], schema_with(df.drop(text), "fp bigint"))


def merged(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component labels after linking ``u`` to ``v``; a label is the least member."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v = u[apart], v[apart]
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        labels = parent[labels]


def _tiled(fps: np.ndarray, labels: np.ndarray, start: int, end: int, sides: np.ndarray | None, radius: int) -> np.ndarray:
    """Compare the members of one bucket, ordered by population count, tile by tile."""
    order = start + np.argsort(np.bitwise_count(fps[start:end]), kind="stable")
    counts = np.bitwise_count(fps[order]).astype(np.int64)
    for i in range(0, len(order), TILE):
        left = order[i : i + TILE]
        for j in range(i, len(order), TILE):
            if counts[j] - counts[min(i + TILE, len(order)) - 1] > radius:
                break
            right = order[j : j + TILE]
            near = np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= radius
            if sides is not None:
                near &= sides[left][:, None] != sides[right][None, :]
            u, v = np.nonzero(near)
            labels = merged(labels, left[u], right[v])
    return labels


def linked(buckets: np.ndarray, fps: np.ndarray, sides: np.ndarray, crossing: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within each run of equal ``buckets``.

    Where ``crossing`` is set, only members of different ``sides`` are compared.
    """
    n = len(fps)
    labels = np.arange(n)
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    lengths = np.diff(np.r_[starts, n])
    place = np.arange(n) - np.repeat(starts, lengths)
    length = np.repeat(lengths, lengths)
    small = length <= SMALL
    pairs = []
    for shift in range(1, SMALL):
        i = np.flatnonzero(small & (place + shift < length))
        if not len(i):
            break
        near = np.bitwise_count(fps[i] ^ fps[i + shift]) <= radius
        near &= ~crossing[i] | (sides[i] != sides[i + shift])
        pairs.append((i[near], i[near] + shift))
    if pairs:
        labels = merged(labels, np.concatenate([u for u, _ in pairs]), np.concatenate([v for _, v in pairs]))
    for start, size in zip(starts[lengths > SMALL], lengths[lengths > SMALL]):
        labels = _tiled(fps, labels, start, start + size, sides if crossing[start] else None, radius)
    member = np.flatnonzero(labels != np.arange(n))
    return fps[member], fps[labels[member]]


def _link_step(radius: int):
    fields = ("band", "bucket", "tile_a", "tile_b", "tile", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]))
            if sum(part.shape[1] for part in held) < GATHERED:
                continue
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero((rows[:4] != rows[:4, -1:]).any(axis=0))
            cut = last[-1] + 1 if len(last) else 0
            held = [rows[:, cut:]]
            if cut:
                yield _edges(rows[:, :cut])
        if held:
            yield _edges(np.concatenate(held, axis=1))

    def _edges(rows: np.ndarray) -> pa.RecordBatch:
        changed = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)
        group = np.r_[0, np.cumsum(changed)]
        a, b = linked(group, rows[5].view(np.uint64), rows[4], rows[2] != rows[3], radius)
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def links(fingerprints: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` that connect all distinct ``fp`` which differ in at most ``radius`` bits, directly or not.

    ``radius`` is 2 at most, since two of four blocks then agree.
    """
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError(f"radius is to be from 0 to {BLOCKS - 2}")
    mask = (1 << BLOCK_BITS) - 1
    block = [F.shiftrightunsigned("fp", k * BLOCK_BITS).bitwiseAND(F.lit(mask)) for k in range(BLOCKS)]
    pairs = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    keys = [F.struct(F.lit(n).alias("band"), (block[i] * (mask + 1) + block[j]).alias("bucket")) for n, (i, j) in enumerate(pairs)]
    spread = fingerprints.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.*")
    sizes = spread.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiles = sizes.select("band", "bucket", F.ceil(F.col("n") / bucket_rows).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    shared = spread.join(tiles, ["band", "bucket"]).withColumn("tile", tile)
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = shared.withColumn("other", others).select(
        "band", "bucket", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), "tile", "fp"
    )
    group = ["band", "bucket", "tile_a", "tile_b"]
    return dealt.repartition(*group).sortWithinPartitions(*group, "fp").mapInArrow(_link_step(radius), "a bigint, b bigint")


def _classes(rows: DataFrame, first: Column, radius: int) -> DataFrame:
    """``fp`` and ``chosen``: the least ``first`` of all rows in the fingerprint's component."""
    own = cut_lineage(rows.groupBy("fp").agg(F.min(first).alias("own")))
    roots = components(links(own, radius))
    members = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    joined = members.join(own, "fp").groupBy("root").agg(F.min("own").alias("chosen"))
    chosen = members.join(joined, "root").select("fp", "chosen")
    return own.join(chosen, "fp", "left").select("fp", F.coalesce("chosen", "own").alias("chosen"))


def simhash_groups(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """For every row ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    A component holds all rows whose fingerprints are linked, directly or through others; its id is the least
    id among them.
    """
    rows = cut_lineage(with_fingerprints(df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), "text", words))
    grouped = rows.join(cut_lineage(_classes(rows, F.col("doc_id"), radius)), "fp")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return grouped.select("doc_id", shown.alias("fingerprint"), F.col("chosen").alias("component_id"))


def keep_one_of_each(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """One row of every group of near-duplicates: the one of the least id, nulls last, then by a hash of the row.

    Columns stay as they are. Of rows that are equal in every column one is kept.
    """
    mark = uuid.uuid4().hex
    key, place = f"_key_{mark}", f"_place_{mark}"
    whole = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in df.columns))
    order = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), whole.alias("key"))
    rows = cut_lineage(with_fingerprints(df.select(order.alias("order"), F.col(text).alias("text")), "text", words))
    kept = _classes(rows, F.col("order"), radius).select(F.col("chosen.key").alias(key)).distinct()
    matched = df.withColumn(key, whole).join(kept, key, "left_semi")
    single = Window.partitionBy(key).orderBy(key)
    return matched.withColumn(place, F.row_number().over(single)).filter(F.col(place) == 1).drop(key, place)
