"""Substring deduplication: passages that occur more than once, found by backward search in FM-indexes.

A window is a run of ``length`` words; it goes if its words also start elsewhere, in the same text or another.
Windows are brought together by content: each has an anchor, its least hash over runs of eight words, so equal
windows have equal anchors. Consecutive windows with one anchor form a piece. Three steps follow.

1. All pieces' anchors are counted. An anchor that occurs once has no repeated window, and its piece is out.
2. Pieces of other anchors are taken once for each distinct content, with the number of their occurrences, and
   dealt to shards by anchor. A shard is indexed in a compressed FM-index (Burrows-Wheeler transform of word
   numbers in a wavelet matrix); its pieces stream through it by backward search, and a window whose interval
   holds two places is repeated. Windows of pieces that occur more than once are repeated already.
3. Repeated ranges go back to the texts they came from, and the words they cover are removed.

Shards have a bounded number of words. An anchor with more distinct pieces than ``ANCHOR_PIECES`` (a passage
found in very many places) would overfill one; its windows are counted by 128-bit digests instead, which is a
plain aggregation. Texts are known by a 64-bit hash and a checksum, so copies share one entry. Hashes of runs
only bring pieces together; the shard compares words.

A null text counts as empty; texts of fewer words than a window lose nothing. Repeated rows are copies of each
other and lose what they share. An empty table gives an empty result. Other columns are not returned.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.batches import slices, through
from folioscope.llm.fm_index import FMIndex
from folioscope.llm.shingles import BROADCAST_ROWS, small_side
from folioscope.session import cut_lineage, drop_table

LENGTH, GRAM = 35, 8
#: Words in a shard's index, and distinct pieces of one anchor that a shard takes.
SHARD_WORDS, ANCHOR_PIECES = 250_000, 2_000
#: Word hashes a worker keeps.
KEPT_WORDS = 200_000

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII blanks."""
    return (text or "").encode().split()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class RunHashes:
    """Hashes of any runs of a sequence of word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, MULTIPLIER)])
        self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, INVERSE)])
        self.sums = np.r_[np.uint64(0), np.cumsum(hashes * powers[:n], dtype=np.uint64)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _mixed(sums + (end - start).astype(np.uint64))


def pieces_of(texts: list[list[bytes]], length: int = LENGTH) -> dict[str, np.ndarray]:
    """Pieces of the texts: ``text`` (position in the list), ``start``, ``words``, ``anchor``, ``content``."""
    sizes = np.array([len(words) for words in texts], np.int64)
    known = word_hashes()
    if len(known) > KEPT_WORDS:
        known.clear()
    total = int(sizes.sum())
    hashes = np.fromiter((known[w] for words in texts for w in words), np.uint64, total)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    runs = RunHashes(hashes)
    starts = np.flatnonzero(np.arange(total) + length <= ends[owner]) if total else np.empty(0, np.int64)
    gram = min(GRAM, length)
    if not len(starts):
        return {k: np.empty(0, np.int64) for k in ("text", "start", "words", "anchor", "content")}
    place = np.arange(total - gram + 1)
    grams = runs.of(place, place + gram)
    least = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1)[starts].argmin(axis=1) + starts
    breaks = np.flatnonzero((np.diff(least) != 0) | (np.diff(starts) != 1)) + 1
    first = starts[np.r_[0, breaks]]
    last = starts[np.r_[breaks, len(starts)] - 1]
    return {
        "text": owner[first],
        "start": first - (ends - sizes)[owner[first]],
        "words": last + length - first,
        "anchor": grams[least[np.r_[0, breaks]]].view(np.int64),
        "content": runs.of(first, last + length).view(np.int64),
    }


def _piece_step(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pieces_of([words_of(t) for t in batch.column("text").to_pylist()], length)
            at = pa.array(found["text"], pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "text_hash": batch.column("text_hash").take(at),
                    "text_sum": batch.column("text_sum").take(at),
                    "start": pa.array(found["start"], pa.int32()),
                    "words": pa.array(found["words"], pa.int32()),
                    "anchor": pa.array(found["anchor"], pa.int64()),
                    "content": pa.array(found["content"], pa.int64()),
                }
            )

    return run


def _cut_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a text and its list of pieces to one row for each piece, with its words."""
    for batch in batches:
        rows: list[tuple] = []
        for text, pieces in zip(batch.column("text").to_pylist(), batch.column("pieces").to_pylist()):
            words = words_of(text)
            for p in pieces:
                rows.append((p["anchor"], p["content"], p["copies"], b" ".join(words[p["start"] : p["start"] + p["words"]])))
        anchor, content, copies, body = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_pydict(
            {
                "anchor": pa.array(anchor, pa.int64()),
                "content": pa.array(content, pa.int64()),
                "copies": pa.array(copies, pa.int64()),
                "body": pa.array(body, pa.binary()),
            }
        )


def ranges_of(repeated: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Word ranges (end exclusive) that windows at the given places cover, joined where they touch."""
    places = np.flatnonzero(repeated)
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > length) + 1
    return list(zip(places[np.r_[0, breaks]].tolist(), (places[np.r_[breaks, len(places)] - 1] + length).tolist()))


def repeated_ranges(bodies: list[list[bytes]], copies: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each distinct piece the word ranges that repeated windows cover, by search in an index of all."""
    number: dict[bytes, int] = {}
    sequence: list[int] = []
    for words in bodies:
        sequence.extend(number.setdefault(w, len(number) + 1) for w in words)
        sequence.append(0)
    text = np.array(sequence, np.int64)
    sizes = np.array([len(words) for words in bodies], np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    windows = np.maximum(sizes - length + 1, 0)
    piece = np.repeat(np.arange(len(bodies)), windows)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    begins = starts[piece] + window
    repeated = np.array(copies, np.int64)[piece] > 1
    alone = np.r_[0, np.cumsum(np.bincount(text)[text] < 2)]  # a word found once cannot be in a repeated window
    open_ = np.flatnonzero(~repeated & (alone[begins + length] == alone[begins]))
    if len(open_):
        repeated[open_] = FMIndex(text, length).repeated(text, begins[open_] + length, length)
    bounds = np.r_[0, np.cumsum(windows)]
    return [ranges_of(repeated[a:b], length) for a, b in zip(bounds[:-1], bounds[1:])]


RANGES = "ranges array<struct<first:int,last:int>>"
RANGES_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _search(length: int):
    def run(shard: pa.Table) -> pa.Table:
        bodies = [b.split() for b in shard.column("body").to_pylist()]
        found = repeated_ranges(bodies, shard.column("copies").to_pylist(), length)
        told = [[{"first": a, "last": b} for a, b in ranges] for ranges in found]
        made = pa.table(
            {
                "anchor": shard.column("anchor"),
                "content": shard.column("content"),
                "ranges": pa.array(told, RANGES_TYPE),
            }
        )
        return made.filter(pa.array([bool(r) for r in told], pa.bool_()))

    return run


def _window_step(length: int):
    """Digests of all windows of the pieces of crowded anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for anchor, content, copies, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "copies", "body"))):
                words = body.split()
                for at in range(len(words) - length + 1):
                    rows.append((anchor, content, copies, at, xxhash.xxh3_128_digest(b" ".join(words[at : at + length]))))
            names = ("anchor", "content", "copies", "place", "digest")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = zip(*rows) if rows else ((),) * len(names)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in zip(names, kinds, columns)})

    return run


def _crowded_ranges(pieces: DataFrame, length: int) -> DataFrame:
    windows = pieces.mapInArrow(
        _window_step(length), "anchor bigint, content bigint, copies bigint, place int, digest binary"
    )
    often = windows.groupBy("digest").agg(F.sum("copies").alias("found")).filter("found > 1").select("digest")
    hit = windows.join(often, "digest")
    last = (F.col("place") + length).cast("int")
    return hit.groupBy("anchor", "content").agg(
        F.collect_list(F.struct(F.col("place").alias("first"), last.alias("last"))).alias("ranges")
    )


def _repeated_pieces(docs: DataFrame, length: int, shard_words: int, anchor_pieces: int) -> DataFrame:
    """``text_hash, text_sum`` of texts that lose words, with the ``ranges`` of these."""
    fields = "text_hash bigint, text_sum bigint, start int, words int, anchor bigint, content bigint"
    pieces = cut_lineage(docs.mapInArrow(_piece_step(length), fields))
    # written, so that the join reads two shuffles and the pieces of a frequent anchor can be split
    anchors = cut_lineage(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    shared = cut_lineage(pieces.join(anchors, "anchor"))
    drop_table(pieces)
    of = F.struct("text_hash", "text_sum", "start", "words")
    distinct = cut_lineage(
        shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(of).alias("of"))
    )
    crowds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > anchor_pieces)
    listed = distinct.groupBy("of.text_hash", "of.text_sum").agg(
        F.collect_list(F.struct("anchor", "content", "copies", "of.start", "of.words")).alias("pieces")
    )
    single = _one_of_each(docs, distinct.select("of.text_hash", "of.text_sum").distinct())
    bodies = cut_lineage(
        single.join(listed, ["text_hash", "text_sum"])
        .select("text", "pieces")
        .mapInArrow(_cut_step, "anchor bigint, content bigint, copies bigint, body binary")
    )
    total = distinct.agg(F.sum("of.words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    crowded = crowds.select("anchor")
    dealt = bodies.join(crowded, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(_search(length), f"anchor bigint, content bigint, {RANGES}")
    ranges = found.unionByName(_crowded_ranges(bodies.join(crowded, "anchor", "left_semi"), length))
    moved = F.transform(
        "ranges",
        lambda r: F.struct((r["first"] + F.col("start")).alias("first"), (r["last"] + F.col("start")).alias("last")),
    )
    back = shared.join(ranges, ["anchor", "content"]).select("text_hash", "text_sum", F.explode(moved).alias("range"))
    return back.groupBy("text_hash", "text_sum").agg(F.collect_set("range").alias("ranges"))


def _one_of_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each of ``keys`` with its text."""
    key = ["text_hash", "text_sum"]
    numbered = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return docs.join(small_side(keys), key, "left_semi").withColumn("_n", numbered).filter("_n = 1").drop("_n")


def _remove_step(id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_texts = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                words = words_of(text)
                gone = np.zeros(len(words) + 1, np.int64)
                for r in ranges or ():
                    gone[r["first"]] += 1
                    gone[r["last"]] -= 1
                stays = np.cumsum(gone)[: len(words)] == 0
                kept_texts.append(b" ".join([w for w, stay in zip(words, stays.tolist()) if stay]) if ranges else b" ".join(words))
                n_words.append(len(words))
                n_removed.append(int(len(words) - stays.sum()))
            yield pa.RecordBatch.from_pydict(
                {
                    id_column: batch.column(id_column),
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_removed": pa.array(n_removed, pa.int64()),
                    "kept": pa.array(kept_texts, pa.binary()).cast(pa.string()),
                }
            )

    return run


def _digest_step(id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(k.encode()).hexdigest() for k in batch.column("kept").to_pylist()]
            columns = {name: batch.column(name) for name in (id_column, "n_words", "n_removed")}
            yield pa.RecordBatch.from_pydict(columns | {"kept_sha256": pa.array(digests, pa.string())})

    return run


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("text_hash"), F.crc32("text").alias("text_sum")]


def dedup_substrings(
    df: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    digests: bool = False,
    shard_words: int = SHARD_WORDS,
    anchor_pieces: int = ANCHOR_PIECES,
) -> DataFrame:
    """Every row's ``n_words``, ``n_removed`` and ``kept`` text (or, with ``digests``, its ``kept_sha256``)."""
    rows = df.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = rows.select("text", *_text_key())
    gone = cut_lineage(_repeated_pieces(docs, length, shard_words, anchor_pieces))
    weight = gone.select(F.sum(F.size("ranges"))).first()[0] or 0
    marked = rows.select(id_column, "text", *_text_key()).join(
        F.broadcast(gone) if weight <= BROADCAST_ROWS else gone, ["text_hash", "text_sum"], "left"
    )
    kind = dict(df.dtypes)[id_column]
    counts = f"`{id_column}` {kind}, n_words bigint, n_removed bigint"
    if digests:
        steps, schema = [_remove_step(id_column), _digest_step(id_column)], f"{counts}, kept_sha256 string"
    else:
        steps, schema = [_remove_step(id_column)], f"{counts}, kept string"
    return through(marked.select(id_column, "text", "ranges"), steps, schema)
