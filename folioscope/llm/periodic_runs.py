"""Runs of words that repeat with a period, found by descending common prefixes.

A run is a stretch of words with smallest period ``q`` that is at least ``LEAST`` words and ``REPEATS`` periods long and
that no neighbouring word extends keeping the period. The suffixes of a text's words are sorted, and adjacent ones
united by decreasing length of their common prefix, as Kruskal's method takes edges; every class is an ordered list
of positions. Positions ``i`` and ``i + d`` that become neighbours in a class at length ``l >= d`` seed a run of ``l + d``
words with period ``d``. A run's first position and the one a period later become neighbours at exactly its length
less one period, as a position between them would shorten the period; so seeds that the word before does not extend
are the runs, each once, and a seed's distance is the smallest period.

A run needs a common prefix of at least ``least - least // repeats`` words. Windows of that many words that occur once in a text can
start no seed; only the others are sorted, and only their classes are united. Texts of a slice are handled
together: a word's number differs from text to text, so no class reaches over two of them.

Null and empty texts have no words and no runs. Very long texts are taken whole, with memory in proportion to one text.
Repeated rows are treated each for itself. Other columns stay, except those that the new ones replace by name.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.batches import schema_with, through, with_columns

#: The shortest run in words and in periods.
LEAST, REPEATS = 24, 3

Run = tuple[int, int, int]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: what blanks, tabs and line ends (U+0009 to U+000D) part."""
    return (text or "").encode().split()


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the texts, one after the other, equal for equal words of one text only, and each word's text."""
    words = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(words) for words in texts])
    return owner * max(1, len(words.dictionary)) + words.indices.to_numpy().astype(np.int64), owner


def _ranked(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def window_ranks(codes: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """For every power of two, up to windows that occur once, the order of the window of that many words at each position.

    A window that leaves its text is cut at the text's end, and comes before longer ones that start with it.
    """
    ranks = [_ranked(codes) + 1]
    ends = np.searchsorted(owner, owner, side="right")
    size, n = 1, len(codes)
    while True:
        last = ranks[-1]
        after = np.arange(n) + size
        rest = np.where(after < ends, last[np.minimum(after, n - 1)], 0)
        stepped = _ranked(last * (n + 1) + rest) + 1
        if (stepped == last).all():
            return ranks
        ranks.append(stepped)
        size *= 2


def common_prefix(ranks: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the texts from ``a`` and from ``b`` on have in common."""
    n, length = len(ends), np.zeros(len(a), np.int64)
    room = np.minimum(ends[a] - a, ends[b] - b)
    for k in range(len(ranks) - 1, -1, -1):
        while True:
            able = length + (1 << k) <= room
            x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
            step = able & (ranks[k][x] == ranks[k][y])
            if not step.any():
                break
            length += np.where(step, 1 << k, 0)
    return length


def seeds(order: list[int], prefix: list[int], least: int) -> Iterator[Run]:
    """``i, d, l`` of positions ``i`` and ``i + d`` that become neighbours when suffixes of prefix ``l`` are united, longest first.

    ``order`` lists the positions as their suffixes are sorted, ``prefix[k]`` is what those at ``k`` and ``k + 1`` share.
    """
    parent = list(range(len(order)))
    classes: list[list[int] | None] = [[at] for at in order]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k in sorted((k for k, shared in enumerate(prefix) if shared >= least), key=lambda k: -prefix[k]):
        shared, small, large = prefix[k], root(k), root(k + 1)
        if len(classes[small]) > len(classes[large]):
            small, large = large, small
        into, joining, joined = classes[large], classes[small], None
        for at, following in zip(joining, [*joining[1:], None]):
            place = bisect.bisect_left(into, at)
            before, after = into[place - 1] if place else None, into[place] if place < len(into) else None
            # neighbours that were in one class already are no new ones
            if before is not None and before != joined and at - before <= shared:
                yield before, at - before, shared
            if after is not None and (following is None or after < following) and after - at <= shared:
                yield at, after - at, shared
            into.insert(place, at)
            joined = at
        classes[small], parent[small] = None, large


def _often(codes: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Whether the window of ``size`` words at each position may occur again in its text, judged by its hash."""
    n = len(codes)
    may = np.zeros(n, bool)
    whole = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :]) if n >= size else np.empty(0, np.int64)
    if not len(whole):
        return may
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        hashed, done, at = np.zeros(n, np.uint64), 0, np.arange(n)
        power, span = mixed, 1
        while span <= size:
            if size & span:
                hashed = hashed * np.uint64(0xD1342543DE82EF95) + power[np.minimum(at + done, n - 1)]
                done += span
            power = power * np.uint64(0xAF251AF3B0F025B5) + power[np.minimum(at + span, n - 1)]
            power ^= power >> np.uint64(31)
            span *= 2
    values, of, counts = np.unique(hashed[whole], return_inverse=True, return_counts=True)
    may[whole[counts[of] > 1]] = True
    return may


def find_runs(texts: list[list[bytes]], least: int = LEAST, repeats: int = REPEATS) -> list[list[Run]]:
    """Start, length and period of every run of each list of words, by start, then period."""
    found: list[list[Run]] = [[] for _ in texts]
    codes, owner = numbered(texts)
    shared = max(1, least - least // repeats)
    may = _often(codes, owner, shared)
    if not may.any():
        return found
    # only texts in which a window occurs again are sorted
    kept = np.isin(owner, np.unique(owner[may]))
    firsts = np.searchsorted(owner, np.arange(len(texts)))
    codes, owner, may, origin = codes[kept], owner[kept], may[kept], np.flatnonzero(kept)
    ends = np.searchsorted(owner, owner, side="right")
    ranks = window_ranks(codes, owner)
    order = np.flatnonzero(may)
    order = order[np.argsort(ranks[-1][order], kind="stable")]
    prefix = common_prefix(ranks, ends, order[:-1], order[1:])
    prefix[owner[order[:-1]] != owner[order[1:]]] = 0
    for at, period, length in seeds(order.tolist(), prefix.tolist(), shared):
        if length + period < max(least, repeats * period):
            continue
        if at and owner[at - 1] == owner[at] and codes[at - 1] == codes[at + period - 1]:
            continue
        text = int(owner[at])
        found[text].append((int(origin[at] - firsts[text]), length + period, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exact exponent, ties to the least start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _runs_step(text: str, least: int, repeats: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(text).to_pylist()]
            runs = find_runs(words, least, repeats)
            told = [[{"start": s, "length": n, "period": p} for s, n, p in rs] for rs in runs]
            plain = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)]
            yield with_columns(batch, {"runs": pa.array(told, kind), "collapsed": pa.array(plain, pa.string())})

    return run


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Add to every row ``runs`` (start, length and period in words) and ``collapsed``, the words that no run repeats.

    ``repeats`` is 2 at least: with fewer a stretch would be a run of any period.
    """
    if repeats < 2 or least < 1:
        raise ValueError("a run has two periods and one word at least")
    added = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return through(df, [_runs_step(text, least, repeats)], schema_with(df, added))


def with_planted_run(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the registered query takes them: of a tenth of the documents the tail repeats a part of itself."""
    if doc_id is None or not words:
        return words
    mark = zlib.crc32(str(doc_id).encode())
    if mark % 10:
        return words
    n, g = len(words), mark // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def _digest_step(least: int, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            words = [with_planted_run(words_of(t), i) for t, i in zip(batch.column("text").to_pylist(), ids)]
            runs = find_runs(words, least, repeats)
            best = [strongest(r) or (None, None, None) for r in runs]
            listed = ["".join(f"{s},{n},{p}\n" for s, n, p in r) for r in runs]
            numbers = {
                "n_runs": [len(r) for r in runs],
                "start": [b[0] for b in best],
                "length": [b[1] for b in best],
                "period": [b[2] for b in best],
                "exponent_milli": [b[1] and 1000 * b[1] // b[2] for b in best],
            }
            digests = {
                "runs_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in listed],
                "collapsed_sha256": [hashlib.sha256(b" ".join(collapsed(w, r))).hexdigest() for w, r in zip(words, runs)],
            }
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id")}
                | {name: pa.array(made, pa.int64()) for name, made in numbers.items()}
                | {name: pa.array(made, pa.string()) for name, made in digests.items()}
            )

    return run


def digest(df: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Number of runs, the strongest one, and digests of all runs and of the words that stay, for planted ``doc_id, text``."""
    schema = (
        "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return through(df.select("doc_id", "text"), [_digest_step(least, repeats)], schema)
