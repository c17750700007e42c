"""Vector bin packing of tokenized examples into sequences, under limits on tokens, segments and loss-bearing tokens.

A sequence is filled by the dot-product heuristic: of the examples that still fit, the one whose demands, weighted by how
scarce each resource is among those left, have the largest inner product with what the sequence has left. Every task packs
its own rows, a window of examples after the other, so no token is shuffled; a sequence's number is made of the
task's partition and a running number, and is the same when a lost task runs again over the same rows.

With ``cut`` examples may be cut anywhere: stretches as long as a sequence are split off first, then the emptiest sequences
of a window are taken apart to fill the gaps of the others, and what then fills no whole sequence is laid into
sequences as long as a power of two, which need no padding. Without ``cut`` an example stays whole; one that exceeds
a limit by itself has a sequence of its own.

Null ids count as empty, and an example without tokens gives no piece; null entries of a loss mask bear no loss, and
without a mask all tokens bear loss. Very long examples are handled one at a time. Rows of equal ids are examples of their own.
Other columns than the key do not come along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folioscope.llm.batches import through
from folioscope.llm.byte_bpe import CODED_BYTES, CODED_ROWS, file_coder

#: Examples and tokens that are packed together.
WINDOW, WINDOW_TOKENS = 2048, 4_000_000
#: Bits of a sequence's number that count within a task.
COUNTED_BITS = 40


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], float)


@dataclass
class Example:
    """An example's key, its ids, and how many of its first tokens bear loss, for every length."""

    key: object
    ids: np.ndarray
    loss: np.ndarray

    def lossy(self, start: int, length: int) -> int:
        return int(self.loss[start + length] - self.loss[start])


@dataclass
class Sequence:
    """Pieces (example, start, length) in order, with their sums."""

    pieces: list[tuple[int, int, int]] = field(default_factory=list)
    tokens: int = 0
    loss: int = 0


def place(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Rows of ``demands`` dealt to bins by the dot-product heuristic; a row above a limit has a bin of its own."""
    alone = (demands > limits).any(axis=1)
    bins = [[int(i)] for i in np.flatnonzero(alone)]
    left = np.flatnonzero(~alone)
    shares = demands[left] / limits
    total = shares.sum(axis=0)
    while len(left):
        scarce = np.maximum(total, 0)
        room, taken = np.ones(shares.shape[1]), []
        active, at = shares, np.arange(len(left))
        while len(at):
            best = int(np.argmax(active @ (scarce * room)))
            taken.append(int(at[best]))
            room = room - active[best]
            # nothing that does not fit now fits later
            fits = (active <= room + 1e-9).all(axis=1)
            fits[best] = False
            active, at = active[fits], at[fits]
        bins.append([int(i) for i in left[taken]])
        total = total - shares[taken].sum(axis=0)
        kept = np.ones(len(left), bool)
        kept[taken] = False
        left, shares = left[kept], shares[kept]
    return bins


def _add(into: Sequence, examples: list[Example], piece: tuple[int, int, int]) -> None:
    into.pieces.append(piece)
    into.tokens += piece[2]
    into.loss += examples[piece[0]].lossy(*piece[1:])


def _move(giver: Sequence, taker: Sequence, examples: list[Example], limits: Limits) -> bool:
    """Move the start of the last piece of ``giver`` to ``taker``, as much as fits; whether anything did."""
    owner, start, length = giver.pieces[-1]
    if len(taker.pieces) >= limits.segments:
        return False
    loss = examples[owner].loss
    able = int(np.searchsorted(loss[start : start + length + 1], loss[start] + limits.loss - taker.loss, side="right")) - 1
    able = min(able, limits.tokens - taker.tokens, length)
    if able <= 0:
        return False
    giver.pieces.pop()
    giver.tokens -= length
    giver.loss -= examples[owner].lossy(start, length)
    _add(taker, examples, (owner, start, able))
    if able < length:
        _add(giver, examples, (owner, start + able, length - able))
    return True


def fill(sequences: list[Sequence], examples: list[Example], limits: Limits) -> list[Sequence]:
    """The sequences with their gaps filled from the emptiest ones."""
    ordered = sorted(sequences, key=lambda s: s.tokens)
    low, high = 0, len(ordered) - 1
    while low < high:
        giver, taker = ordered[low], ordered[high]
        if taker.tokens >= limits.tokens or not _move(giver, taker, examples, limits):
            high -= 1
        elif not giver.pieces:
            low += 1
    return ordered[low:]


def in_powers(sequence: Sequence, examples: list[Example], limits: Limits) -> list[Sequence]:
    """The sequence, or if padding would be due, its tokens in sequences as long as the powers of two in their number."""
    if sequence.tokens >= limits.tokens or sequence.tokens & (sequence.tokens - 1) == 0:
        return [sequence]
    wanted = [1 << b for b in range(sequence.tokens.bit_length() - 1, -1, -1) if sequence.tokens >> b & 1]
    made, pieces = [], sequence.pieces[::-1]
    for size in wanted:
        own = Sequence()
        while own.tokens < size:
            owner, start, length = pieces.pop()
            taken = min(length, size - own.tokens)
            _add(own, examples, (owner, start, taken))
            if taken < length:
                pieces.append((owner, start + taken, length - taken))
        made.append(own)
    return made


def pack_window(examples: list[Example], limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """The pieces of each sequence."""
    whole, rest = [], []
    for at, example in enumerate(examples):
        start, n = 0, len(example.ids)
        if cut:
            # the longest stretch that a sequence may hold goes first, as long as there is more
            while n - start > limits.tokens or example.lossy(start, n - start) > limits.loss:
                room = int(np.searchsorted(example.loss[start:], example.loss[start] + limits.loss, side="right")) - 1
                length = min(limits.tokens, room)
                (whole if length == limits.tokens else rest).append((at, start, length))
                start += length
        if n > start:
            (whole if n - start == limits.tokens else rest).append((at, start, n - start))
    sequences = [[piece] for piece in whole]
    if rest:
        demands = np.array([(n, 1, examples[at].lossy(start, n)) for at, start, n in rest], float)
        made = []
        for members in place(demands, limits.array()):
            made.append(Sequence())
            for member in members:
                _add(made[-1], examples, rest[member])
        if cut:
            made = [part for s in fill(made, examples, limits) for part in in_powers(s, examples, limits)]
        sequences += [s.pieces for s in made]
    return sequences


def _examples(batch: pa.RecordBatch, key: str, ids: str, loss: str | None) -> Iterator[Example]:
    keys, lists = batch.column(key).to_pylist(), batch.column(ids)
    values, bounds = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy().tolist()
    valid = lists.is_valid().to_pylist()
    masks = batch.column(loss).to_pylist() if loss else [None] * batch.num_rows
    for at, (own_key, mask) in enumerate(zip(keys, masks)):
        own = values[bounds[at] : bounds[at + 1]] if valid[at] else values[:0]
        if mask is None:
            bears = np.arange(len(own) + 1)
        elif len(mask) != len(own):
            raise ValueError("a loss mask has an entry for each id")
        else:
            bears = np.concatenate([[0], np.cumsum([bool(m) for m in mask])]).astype(np.int64)
        yield Example(own_key, own, bears)


def pack_step(key: str, ids: str, loss: str | None, limits: Limits, cut: bool):
    """A batch function from examples to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << COUNTED_BITS
        held: list[Example] = []
        tokens, kind = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal number
            rows: dict[str, list] = {name: [] for name in (key, "start", "length", "tokens", "loss_tokens", "sequence_id", "offset")}
            parts = []
            for pieces in pack_window(held, limits, cut):
                offset = 0
                for at, start, length in pieces:
                    own = held[at]
                    values = (own.key, start, length, len(own.ids), own.lossy(start, length), number, offset)
                    for name, value in zip(rows, values):
                        rows[name].append(value)
                    parts.append(own.ids[start : start + length])
                    offset += length
                number += 1
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
            made = {name: pa.array(values, kind if name == key else pa.int64()) for name, values in rows.items()}
            return pa.RecordBatch.from_pydict(made | {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

        for batch in batches:
            kind = batch.schema.field(key).type
            for example in _examples(batch, key, ids, loss):
                held.append(example)
                tokens += len(example.ids)
                if len(held) >= WINDOW or tokens >= WINDOW_TOKENS:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    return run


def pack(
    df: DataFrame, key: str, limits: Limits = Limits(), cut: bool = False, ids: str = "ids", loss: str | None = None
) -> DataFrame:
    """Pieces of examples in sequences: the key, ``start``, ``length``, the example's ``tokens``, ``loss_tokens``, ``sequence_id``, ``offset``, ``ids``."""
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("a sequence holds one token, one segment and one loss-bearing token at least")
    schema = (
        f"`{key}` {df.schema[key].dataType.simpleString()}, start bigint, length bigint, tokens bigint, loss_tokens bigint, "
        "sequence_id bigint, offset bigint, ids array<int>"
    )
    chosen = df.select(key, ids, *([loss] if loss else []))
    return through(chosen, [pack_step(key, ids, loss, limits, cut)], schema)


def ended_ids_step(path: str, end: int, text: str = "text"):
    """A batch function that gives ``ids``, a text's ids by the tokenizer file and ``end`` after them, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = file_coder(path)
        for batch in batches:
            ids, bounds = code.chunks.coded([t or "" for t in batch.column(text).to_pylist()])
            ended = np.insert(ids.astype(np.int32), bounds[1:], end)
            bounds = (bounds + np.arange(len(bounds))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ended))
            kept = {name: batch.column(name) for name in batch.schema.names if name != text}
            yield pa.RecordBatch.from_pydict(kept | {"ids": lists})

    return run


def _digest_step():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, bounds = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            named = {"doc_id": "doc_id", "start": "start", "length": "length"}
            kept = {name: batch.column(source) for name, source in named.items()}
            yield pa.RecordBatch.from_pydict(
                kept
                | {"ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": batch.column("tokens")}
                | {name: batch.column(name) for name in ("sequence_id", "offset")}
            )

    return run


def pack_documents(df: DataFrame, path: str, end: int, limits: Limits = Limits()) -> DataFrame:
    """Every piece of ``doc_id, text``, ended by the id ``end`` and cut freely, with a checksum of its ids, in one pass."""
    steps = [ended_ids_step(path, end), pack_step("doc_id", "ids", None, limits, True), _digest_step()]
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return through(df.select("doc_id", "text"), steps, schema, CODED_ROWS, CODED_BYTES)
