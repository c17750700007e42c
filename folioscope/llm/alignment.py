"""Alignment of two tokenizers over the same texts, and how usual each link of two ids is in the corpus.

Both tokenizers read a blank and the text. Dictionaries from byte ends to token numbers are intersected by their
keys; the common ends, sorted, slice both id lists into groups, and within a slice every two tokens whose byte ranges
overlap are linked. A group of one token on either side is one link.

How many documents hold an id pair is counted over all documents: every document's distinct pairs are written once,
counted by Spark, and read again. The counts of the most usual pairs (``HEAD`` at most) reach every task; the other pairs
are joined with their counts by a shuffle, in which no pair is frequent. Which pairs are in the head changes the work,
never the result.

A null or empty text, and one whose tokens of either kind are not the bytes of blank and text together, has no
tokens, groups or links. Very long texts are taken whole; repeated rows count as often as they occur.
``align`` keeps other columns, except those that the new ones replace by name; ``link_counts`` keeps the id alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.batches import schema_with, through, with_columns
from folioscope.llm.byte_bpe import FILE_CHUNKS, ChunkCoder, file_coder
from folioscope.session import cut_lineage, drop_table

#: Most id pairs whose counts every task holds, 17 bytes each.
HEAD = 500_000
#: Rows and bytes that are aligned at once.
CODED_ROWS, CODED_BYTES = 1024, 2_000_000


#: Texts, a blank before them, that are not parted by single blanks, or hold what stands for a blank in pieces.
UNEVEN = "  | $|[\u2581\\x00]"


class PieceCoder:
    """A piece vocabulary: ids of texts, and the bytes of each id.

    If no piece has a blank after another sign, no token reaches from one word into the next, so each distinct word lately
    seen is encoded once.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens, whole = [], UNEVEN
        for number in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(number)
            by_byte = self.model.is_byte(number)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if by_byte else piece.replace("▁", " ").encode())
            if "▁" in piece.lstrip("▁"):
                whole = ""
        self.lengths = np.array([len(token) for token in self.tokens], np.int64)
        self.chunks = ChunkCoder(self._whole_ids, self.lengths, FILE_CHUNKS, whole)

    def _whole_ids(self, texts: list[str]) -> list[np.ndarray]:
        # the model adds the blank that every text begins with
        return [np.asarray(ids, "<u4") for ids in self.model.encode([t[1:] for t in texts], num_threads=1)]


@functools.lru_cache(maxsize=4)
def table_of(code) -> "Table":
    """The bytes of a coder's ids."""
    return Table(code.tokens)


@functools.lru_cache(maxsize=2)
def piece_coder(path: str) -> PieceCoder:
    """One coder for each model file and worker process."""
    return PieceCoder(path)


def groups_of(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of either list end at or before each byte where tokens of both end."""
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    return [a_at[end] for end in common], [b_at[end] for end in common]


def links_of(a_stops: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of both sides for every two tokens whose byte ranges overlap, and each link's group, in order.

    In a slice every byte at which a token of either side ends is the last that some two tokens share.
    """
    shared = np.union1d(a_ends, b_ends)
    common = a_ends[a_stops - 1]
    return np.searchsorted(a_ends, shared), np.searchsorted(b_ends, shared), np.searchsorted(common, shared)


class Table:
    """The bytes of all ids of a vocabulary, to be put together for many ids at once."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(token) for token in tokens], np.int64)
        self.ends, self.flat = np.cumsum(self.lengths), np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        upto = np.cumsum(lengths)
        at = np.repeat(self.ends[ids] - upto, lengths) + np.arange(int(upto[-1]) if len(upto) else 0)
        return self.flat[at].tobytes()


@dataclass(frozen=True)
class Side:
    """The ids of one tokenizer for several texts, one after the other: where each text's begin, and the byte end of each id."""

    ids: np.ndarray
    bounds: np.ndarray
    ends: np.ndarray


def _side(coder, table: Table, texts: list[str]) -> tuple[Side, bytes, np.ndarray]:
    """The ids of texts, their joined bytes, and where each text's bytes begin."""
    ids, bounds = coder.chunks.coded([" " + t for t in texts])
    ends = np.cumsum(table.lengths[ids])
    starts = np.concatenate([[0], ends])[bounds]
    return Side(ids, bounds, ends), table.joined(ids), starts


def coded(texts: list[str | None], a_path: str, b_path: str) -> tuple[Side, Side]:
    """Both tokenizers' ids of all texts; none for a text that is empty or whose tokens are not the bytes of blank and text."""
    given = [t or "" for t in texts]
    a_code, b_code = file_coder(a_path), piece_coder(b_path)
    made = [_side(code, table_of(code), given) for code in (a_code, b_code)]
    dropped = np.array(
        [not t or any(raw[starts[i] : starts[i + 1]] != (" " + t).encode() for _, raw, starts in made) for i, t in enumerate(given)], bool
    )
    sides = []
    for (side, _, _), code in zip(made, (a_code, b_code)):
        sizes = np.diff(side.bounds)
        ids = side.ids[~np.repeat(dropped, sizes)]
        bounds = np.concatenate([[0], np.cumsum(np.where(dropped, 0, sizes))])
        sides.append(Side(ids, bounds, np.cumsum(table_of(code).lengths[ids])))
    return sides[0], sides[1]


def text_groups(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens of either side, over all texts, end with each group, and where each text's groups begin.

    Byte ends run on from text to text, so the last end of a text is common to both sides.
    """
    a_stops, b_stops, bounds = [], [], [0]
    a_ends, b_ends = a.ends.tolist(), b.ends.tolist()
    a_bounds, b_bounds = a.bounds.tolist(), b.bounds.tolist()
    for a_from, a_to, b_from, b_to in zip(a_bounds, a_bounds[1:], b_bounds, b_bounds[1:]):
        own = groups_of(a_ends[a_from:a_to], b_ends[b_from:b_to])
        a_stops.append(np.array(own[0], np.int64) + a_from)
        b_stops.append(np.array(own[1], np.int64) + b_from)
        bounds.append(bounds[-1] + len(own[0]))
    return np.concatenate(a_stops), np.concatenate(b_stops), np.array(bounds)


def _align_step(a_path: str, b_path: str, text: str):
    number = pa.int32()

    def pairs(bounds: np.ndarray, **columns: np.ndarray) -> pa.Array:
        made = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in columns.values()], list(columns))
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = coded(batch.column(text).to_pylist(), a_path, b_path)
            a_stops, b_stops, bounds = text_groups(a, b)
            a_links, b_links, owner = links_of(a_stops, a.ends, b.ends)
            group_text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            link_text = group_text[owner]
            link_bounds = np.searchsorted(link_text, np.arange(batch.num_rows + 1))
            ids = [pa.ListArray.from_arrays(pa.array(s.bounds.astype(np.int32)), pa.array(s.ids.astype(np.int32), number)) for s in (a, b)]
            added = {
                "a_ids": ids[0],
                "b_ids": ids[1],
                "groups": pairs(bounds, a_end=a_stops - a.bounds[group_text], b_end=b_stops - b.bounds[group_text]),
                "links": pairs(link_bounds, a_at=a_links - a.bounds[link_text], b_at=b_links - b.bounds[link_text]),
            }
            yield with_columns(batch, added)

    return run


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Add ``a_ids``, ``b_ids``, ``groups`` (how many tokens of each list end with the group) and ``links`` (token numbers from 0)."""
    added = (
        "a_ids array<int>, b_ids array<int>, groups array<struct<a_end:int,b_end:int>>, links array<struct<a_at:int,b_at:int>>"
    )
    return through(df, [_align_step(a_path, b_path, text)], schema_with(df, added), CODED_ROWS, CODED_BYTES)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


class PairNames(dict):
    """What a group of one token on either side is called, by its pair, and the names of both sides' ids."""

    def __init__(self, n_a: int, n_b: int):
        super().__init__()
        self.width = n_b
        self.a, self.b = [str(i) for i in range(n_a)], [str(i) for i in range(n_b)]

    def __missing__(self, pair: int) -> str:
        name = f"{pair // self.width}|{pair % self.width}"
        if len(self) < HEAD:
            self[pair] = name
        return name


def told_groups(a: Side, b: Side, groups: tuple[np.ndarray, np.ndarray, np.ndarray], owner: np.ndarray, linked: np.ndarray, names: PairNames) -> list[str]:
    """The groups of each text as ``a1,a2|b1;a3|b2``: ids of both sides."""
    often = np.bincount(owner, minlength=len(groups[0]))
    firsts = np.cumsum(often) - often
    told = [names[pair] for pair in linked[firsts].tolist()]
    a_ids, b_ids = a.ids.tolist(), b.ids.tolist()
    several = np.flatnonzero(often > 1)
    spans = [np.concatenate([[0], stops]) for stops in groups[:2]]
    edges = (spans[0][several], spans[0][several + 1], spans[1][several], spans[1][several + 1])
    a_name, b_name = names.a.__getitem__, names.b.__getitem__
    for g, a_from, a_to, b_from, b_to in zip(several.tolist(), *(e.tolist() for e in edges)):
        told[g] = ",".join(map(a_name, a_ids[a_from:a_to])) + "|" + ",".join(map(b_name, b_ids[b_from:b_to]))
    bounds = groups[2].tolist()
    return [";".join(told[x:y]) for x, y in zip(bounds, bounds[1:])]


def _pairs_step(a_path: str, b_path: str):
    """A batch function to counts, the digest of the groups, and the distinct id pairs with how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(piece_coder(b_path).tokens)
        names = PairNames(len(file_coder(a_path).tokens), width)
        for batch in batches:
            n = batch.num_rows
            a, b = coded(batch.column("text").to_pylist(), a_path, b_path)
            groups = text_groups(a, b)
            a_links, b_links, owner = links_of(groups[0], a.ends, b.ends)
            linked = a.ids[a_links].astype(np.int64) * width + b.ids[b_links]
            told = told_groups(a, b, groups, owner, linked, names)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told]
            text_of = np.repeat(np.arange(n), np.diff(groups[2]))[owner]
            order = np.lexsort((linked, text_of))
            pair, at = linked[order], text_of[order]
            first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (at[1:] != at[:-1])])) if len(pair) else order
            often = np.diff(np.append(first, len(pair)))
            bounds = pa.array(np.searchsorted(at[first], np.arange(n + 1)).astype(np.int32))
            counts = {
                "n_a": np.diff(a.bounds),
                "n_b": np.diff(b.bounds),
                "n_groups": np.diff(groups[2]),
                "n_links": np.bincount(text_of, minlength=n),
            }
            made = {"row": batch.column("row"), "id": batch.column("id")}
            made |= {name: pa.array(values.astype(np.int64)) for name, values in counts.items()}
            made["groups_sha256"] = pa.array(digests, pa.string())
            made["pairs"] = pa.ListArray.from_arrays(bounds, pa.array(pair[first], pa.int64()))
            made["times"] = pa.ListArray.from_arrays(bounds, pa.array(often.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(made)

    return run


COUNTED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def _score_step(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """A batch function that sums what the head knows, and hands on the pairs it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            own, times = lists.values.to_numpy(), batch.column("times").values.to_numpy().astype(np.int64)
            ends = lists.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            own, times = own[ends[0] : ends[-1]], times[ends[0] : ends[-1]]
            at = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
            known = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            at, row_known, times_known = at[known], row[known], times[known]
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row_known, times_known * counts[at])
            np.add.at(bests, row_known, times_known * best[at])
            cuts = np.cumsum(np.bincount(row[~known], minlength=batch.num_rows))[:-1]
            kept = {name: batch.column(name) for name in batch.schema.names if name not in ("pairs", "times")}
            added = {
                "head_best": pa.array(bests),
                "head_sum": pa.array(sums),
                "pairs": _lists(np.split(own[~known], cuts), pa.int64()),
                "times": _lists([t.astype(np.int32) for t in np.split(times[~known], cuts)], pa.int32()),
            }
            yield pa.RecordBatch.from_pydict(kept | added)

    return run


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: in how many rows of ``linked`` each pair is, and whether no pair of the same first id is in more."""
    counts = cut_lineage(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    first = F.floor(F.col("pair") / width)
    most = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    told = counts.withColumn("first", first).join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = cut_lineage(told)
    drop_table(counts)
    return told


def head_of(counts: DataFrame, most: int) -> DataFrame:
    """The most usual pairs, ``most`` at most: all whose count reaches a step of an eighth of an octave."""
    step = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for size in sizes:
        total += size.pairs
        if total > most:
            break
        least = size.step
    return counts.filter(F.lit(False) if least is None else step >= least)


def link_counts(df: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's tokens, groups and links, ``n_best`` and ``count_sum`` of its links, and a digest of its groups.

    A pair's count is the number of rows that hold it linked. ``n_best`` counts links whose pair has the highest count of its
    first id, ties included; ``count_sum`` sums the counts over all links.
    """
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).alias("text"))
    kept = f"row bigint, id {kind}, {COUNTED}"
    lists = "pairs array<bigint>, times array<int>"
    linked = cut_lineage(through(rows, [_pairs_step(a_path, b_path)], f"{kept}, {lists}", CODED_ROWS, CODED_BYTES))
    counts = pair_counts(linked, len(piece_coder(b_path).tokens))
    head = head_of(counts, HEAD).toPandas().sort_values("pair")
    step = _score_step(head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64), head["best"].to_numpy(bool))
    scored = cut_lineage(through(linked, [step], f"{kept}, head_best bigint, head_sum bigint, {lists}"))
    drop_table(linked)
    rest = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("held")).select("row", "held.*")
    sums = (
        rest.join(counts, F.col("pairs") == F.col("pair"))
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rest_best"), F.sum(F.col("times") * F.col("n")).alias("rest_sum"))
    )
    told = scored.join(sums, "row", "left")
    return told.select(
        F.col("id").alias(id_column),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("head_best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"),
        (F.col("head_sum") + F.coalesce("rest_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
