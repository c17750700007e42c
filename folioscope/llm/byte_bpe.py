"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A rank file gives the vocabulary. Every way in which two tokens join to a third is a merge, ordered by the
rank of what it makes, so that the library merges as the ranks say; a piece that is itself a token is taken
whole. With the public pattern texts are cut at white space, where none of its pieces can reach across, and a
chunk seen lately is not encoded again; with any other pattern texts are encoded whole. Offsets follow from the tokens' byte lengths; a byte-to-character table turns them
into character positions, where a character split between tokens belongs to each of them.

A null text counts as empty and has no tokens. Rows, repeated or not, are encoded each for itself; other
columns stay, except those that the new ones replace by name. Decoding gives bytes exactly; as text, bytes
that are no whole character become U+FFFD, and so does an id outside the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from folioscope.llm.batches import schema_with, through, with_columns

# The white space of Unicode, as the patterns' \s reads it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: A blank next to another white-space character: such a text is not parted by single blanks alone.
WIDE_GAP = f" [{BLANK}]|[{BLANK.replace(' ', '')}] "
BLANK_SIGNS = frozenset(sign for sign in map(chr, range(0x3001)) if re.match(f"[{BLANK}]", sign))

#: Chunks that a generation of a worker's cache holds, two at a time, and the longest chunk that is kept.
KEPT_CHUNKS, KEPT_LENGTH = 150_000, 64
#: The same for tokenizer files.
FILE_CHUNKS = 300_000
#: Bytes of new chunks that are encoded as one text.
JOINED = 4_000
#: Rows and bytes that are encoded at once: the more, the fewer chunks are looked up twice.
CODED_ROWS, CODED_BYTES = 2048, 4_000_000
#: The bytes where texts, ids and decoded bytes are handed on: a worker then holds some 80 MB less.
BACK_BYTES = 1_000_000

UNKNOWN = "\ufffd".encode()


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Recent:
    """What was lately encoded: two generations, of which the older goes when the younger is full."""

    def __init__(self, kept: int):
        self.kept = kept
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, distinct: list[str]) -> list[str]:
        """What of ``distinct`` is not known; all else is in the younger generation now."""
        young, old = self.young, self.old
        new = [part for part in distinct if part not in young]
        if not old:
            return new
        young.update((part, old[part]) for part in new if part in old)
        return [part for part in new if part not in old]

    def trim(self, new: list[str]) -> None:
        """Forget long ones among ``new``, and the older generation if the younger is full."""
        for part in new:
            if len(part) > KEPT_LENGTH:
                del self.young[part]
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}


def library_ids(tokenizer: Tokenizer) -> Callable[[list[str]], list[np.ndarray]]:
    """The ids of whole texts by the tokenizers library."""

    def whole_ids(texts: list[str]) -> list[np.ndarray]:
        made = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(m.ids, dtype="<u4") for m in made]

    return whole_ids


class ChunkCoder:
    """A tokenizer, of which no token reaches over the cuts of ``CHUNK``, on each distinct chunk lately seen.

    Most texts are parted by single blanks; these are cut at the blanks alone, as a blank and what follows up to the next are
    whole chunks. ``lengths`` has the bytes of every id. New chunks that begin with one blank are encoded together, as the
    cuts between them are cuts of the joined text as well, and parted by the byte lengths of their ids. Texts that match
    ``whole`` are not cut at single blanks; if it is given, not at all.
    """

    def __init__(self, whole_ids: Callable[[list[str]], list[np.ndarray]], lengths: np.ndarray, kept: int | None = None, whole: str | None = None):
        self.whole_ids, self.lengths, self.whole = whole_ids, lengths, WIDE_GAP if whole is None else whole
        self.rest_ids = self._chunk_ids if whole is None else self._text_ids
        self.chunks, self.spaced = Recent(kept or KEPT_CHUNKS), Recent(kept or KEPT_CHUNKS)

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that begin with one blank and end with none."""
        sizes = np.array([len(chunk.encode()) for chunk in chunks], np.int64)
        group_of = np.cumsum(sizes) // JOINED
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group_of)) + 1, [len(chunks)]]).tolist()
        pieces = list(zip(cuts, cuts[1:])) if chunks else []
        found: list[bytes] = []
        for (first, last), ids in zip(pieces, self.whole_ids(["".join(chunks[a:b]) for a, b in pieces])):
            upto, wanted = np.cumsum(self.lengths[ids]), np.cumsum(sizes[first:last])
            stops = np.searchsorted(upto, wanted)
            if not len(upto) or upto[-1] != wanted[-1] or (upto[stops] != wanted).any():
                # the tokens are not the bytes of the text, so they do not tell where a chunk ends
                found += [alone.tobytes() for alone in self.whole_ids(chunks[first:last])]
                continue
            at, raw = (4 * (stops + 1)).tolist(), ids.tobytes()
            found += [raw[a:b] for a, b in zip([0, *at], at)]
        return found

    def _put(self, known: Recent, new: list[str], lead: str) -> None:
        """Encode ``lead`` and each of ``new`` after it."""
        led = [lead + c for c in new]
        plain = [chunk[0] == " " and chunk[-1] not in BLANK_SIGNS for chunk in led]
        known.young.update(zip(compress(new, plain), self._joined(list(compress(led, plain)))))
        if not all(plain):
            other = [not p for p in plain]
            known.young.update(zip(compress(new, other), [ids.tobytes() for ids in self.whole_ids(list(compress(led, other)))]))

    def _text_ids(self, texts: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self.whole_ids(texts)]

    def _chunk_ids(self, texts: list[str]) -> list[bytes]:
        parts = [CHUNK.findall(text) for text in texts]
        new = self.chunks.missing(list(set().union(*parts)))
        self._put(self.chunks, new, "")
        young = self.chunks.young
        made = [b"".join([young[c] for c in chunks]) for chunks in parts]
        self.chunks.trim(new)
        return made

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and the last one's end."""
        given = pa.array(texts, pa.string())
        wide = pc.match_substring_regex(given, self.whole).to_numpy(zero_copy_only=False)
        # a text that is not parted by single blanks alone goes as one first word
        words = pc.split_pattern(pc.if_else(pa.array(wide), "", given), " ")
        numbered = words.flatten().dictionary_encode()
        starts = words.offsets.to_numpy().astype(np.int64)
        places = numbered.indices.to_numpy().astype(np.int64)
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False)
        firsts = np.zeros(len(places), bool)
        firsts[starts[:-1]] = True
        used = np.zeros(len(distinct), bool)
        used[places[~firsts]] = True
        needed = np.flatnonzero(used)
        spaced = distinct[needed].tolist()
        whole = self.rest_ids([t if w else distinct[n] for t, w, n in zip(texts, wide, places[starts[:-1]])])
        new = self.spaced.missing(spaced)
        self._put(self.spaced, new, " ")
        held = whole + [self.spaced.young[word] for word in spaced]
        self.spaced.trim(new)
        # every word's row among what is held: each text's own first word, then the distinct others
        row = np.empty(len(distinct), np.int64)
        row[needed] = len(texts) + np.arange(len(needed))
        rows = row[places]
        rows[firsts] = np.arange(len(texts))
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        flat, ends = np.frombuffer(b"".join(held), "<u4"), np.cumsum(sizes)
        lengths = sizes[rows]
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        at = np.repeat(ends[rows] - upto, lengths) + np.arange(total)
        bounds = np.concatenate([[0], upto])[starts]
        return flat[at], bounds

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        flat, bounds = self.coded(texts)
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


class Coder:
    """The tokens of a rank file, the library's tokenizer for them, and the byte table that reverses it."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        signs = byte_characters()
        shown = {token: "".join(signs[b] for b in token) for token in ranks}
        merges = [
            (shown[token[:i]], shown[token[i:]])
            for token in sorted(ranks, key=ranks.get)
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        vocabulary = {shown[token]: rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocabulary, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        byte_of = {sign: b for b, sign in enumerate(signs)}
        self.tokens = {rank: bytes(byte_of[sign] for sign in token) for token, rank in vocabulary.items()}
        lengths = np.zeros(max(self.tokens, default=0) + 1, np.int64)
        lengths[list(self.tokens)] = [len(token) for token in self.tokens.values()]
        self.chunks = ChunkCoder(library_ids(self.tokenizer), lengths)
        self.cut = pattern == public_tokenizers.PATTERN

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.chunks.ids_of(texts) if self.cut else [ids.tobytes() for ids in self.chunks.whole_ids(texts)]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        token = self.tokens.get
        return b"".join([token(i, UNKNOWN) for i in ids.tolist()])


class FileCoder:
    """A byte-level tokenizer file: the ids of texts without special tokens, and the bytes of each id."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        told = json.loads(tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        if told["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary with the public pattern")
        tokenizer.encode_special_tokens = True
        byte_of = {sign: b for b, sign in enumerate(byte_characters())}
        self.tokens = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
        for token, number in tokenizer.get_vocab(with_added_tokens=True).items():
            self.tokens[number] = bytes(byte_of[sign] for sign in token)
        lengths = np.array([len(token) for token in self.tokens], np.int64)
        self.chunks = ChunkCoder(self._rank_ids(told) or library_ids(tokenizer), lengths, FILE_CHUNKS)

    def _rank_ids(self, told: dict) -> Callable[[list[str]], list[np.ndarray]] | None:
        """The same ids by the tiktoken library, a few times as fast, if every merge makes the token of the next id."""
        special = {token["id"] for token in told["added_tokens"]}
        vocabulary = told["model"]["vocab"]
        merged = [vocabulary["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in told["model"]["merges"]]
        if merged != sorted(merged) or len(merged) + 256 + len(special) != len(self.tokens):
            return None
        ranks = {token: number for number, token in enumerate(self.tokens) if number not in special}
        coding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [np.asarray(ids, dtype="<u4") for ids in coding.encode_ordinary_batch(texts, num_threads=1)]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in self.chunks.ids_of(texts)]


@functools.lru_cache(maxsize=2)
def file_coder(path: str) -> FileCoder:
    """One coder for each tokenizer file and worker process."""
    return FileCoder(path)


@functools.lru_cache(maxsize=4)
def coder(ranks_path: str, pattern: str) -> Coder:
    """One coder for each vocabulary and worker process."""
    return Coder(ranks_path, pattern)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def character_spans(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) in characters of consecutive tokens with these byte lengths."""
    starts_character = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    character = np.cumsum(starts_character) - 1
    ends = np.cumsum(lengths)
    if not len(ends):
        return ends, ends
    return character[ends - lengths], character[ends - 1] + 1


def encode_step(ranks_path: str, pattern: str, text: str = "text", offsets: bool = True):
    """A batch function that adds ``ids`` and, if asked for, ``starts`` and ``ends`` in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            ids = [np.frombuffer(found, "<u4") for found in code.ids_of(texts)]
            added = {"ids": _lists(ids)}
            if offsets:
                spans = [
                    character_spans(t.encode(), np.array([len(code.tokens[i]) for i in found.tolist()], np.int64))
                    for t, found in zip(texts, ids)
                ]
                added |= {"starts": _lists([s for s, _ in spans]), "ends": _lists([e for _, e in spans])}
            yield with_columns(batch, added)

    return run


def decode_step(ranks_path: str, pattern: str, ids: str = "ids", as_text: bool = True):
    """A batch function that adds ``decoded`` (bytes) and, if asked for, ``decoded_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for batch in batches:
            lists = batch.column(ids)
            values = lists.values.to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy()
            made = [
                code.bytes_of(values[a:b]) if valid else None
                for a, b, valid in zip(bounds[:-1], bounds[1:], lists.is_valid().to_pylist())
            ]
            added = {"decoded": pa.array(made, pa.binary())}
            if as_text:
                added["decoded_text"] = pa.array([m if m is None else m.decode(errors="replace") for m in made], pa.string())
            yield with_columns(batch, added)

    return run


def digest_step(id_column: str = "doc_id"):
    """A batch function from ids and decoded bytes to their counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            bounds = lists.offsets.to_numpy()
            parts = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_pydict(
                {
                    id_column: batch.column(id_column),
                    "n_tokens": pa.array([len(p) // 4 for p in parts], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
                    "decoded_sha256": pa.array(
                        [hashlib.sha256(d).hexdigest() for d in batch.column("decoded").to_pylist()], pa.string()
                    ),
                }
            )

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Add token ``ids`` and their character spans ``starts``, ``ends`` to every row."""
    added = "ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return through(df, [encode_step(ranks_path, pattern, text, offsets)], schema_with(df, added))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add the bytes ``decoded`` and the text ``decoded_text`` of the ids; null for null ids."""
    return through(df, [decode_step(ranks_path, pattern, ids)], schema_with(df, "decoded binary, decoded_text string"))


def encode_and_back(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add token ``ids`` to every row, and the bytes ``decoded`` from them, in one pass: a task needs one worker and one coder."""
    steps = [encode_step(ranks_path, pattern, text, offsets=False), decode_step(ranks_path, pattern, as_text=False)]
    return through(df, steps, schema_with(df, "ids array<int>, decoded binary"), CODED_ROWS, BACK_BYTES)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and give counts and digests of both, in one pass."""
    steps = [
        encode_step(ranks_path, pattern, text, offsets=False),
        decode_step(ranks_path, pattern, as_text=False),
        digest_step(id_column),
    ]
    kind = dict(df.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return through(df.select(id_column, text), steps, schema, CODED_ROWS, CODED_BYTES)
