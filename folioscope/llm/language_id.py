"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent 1- to 3-grams of letters in order of frequency; words are bounded by a
blank, and no n-gram reaches over one. A document is compared to every language's profile by out-of-place
distance: the sum over its own profile of how far each n-gram's rank lies from the language's, with the full
profile length for an n-gram the language lacks. The language of the least distance wins, ties going to the
first by name. The score is one minus the distance's share of its maximum.

Language profiles count all learning rows; counts are summed inside each task, then shuffled by n-gram, and
the most frequent ones are picked in two steps so that no task ranks a whole language. What reaches the
driver is ``PROFILE`` n-grams for each language.

A null text or one without letters gives ``und`` and score 0, and so does everything if nothing was learned.
Rows with a null language teach nothing. Texts are used whole, whatever their length; repeated rows count as
often as they occur. Other columns stay, except those the result replaces by name.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.batches import schema_with, slices, through, with_columns
from folioscope.session import cut_lineage

PROFILE = 300
UNKNOWN = "und"
#: Most languages a profile table may hold; it reaches the driver and every task (300 n-grams for each).
MAX_LANGUAGES = 20_000
#: Distinct n-grams a task holds before it hands its counts on.
HELD_GRAMS = 400_000

#: Bounds for clean texts: the share of this quantile of their scores, in classes of length with as many rows.
LOW, MARGIN, CLASS_ROWS = 0.01, 0.75, 100

CODE_BITS = 21
#: What stands in the first character's place for n-grams of one and of two characters.
ONE, TWO = (1 << CODE_BITS) - 1, (1 << CODE_BITS) - 2


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(code).isalpha() for code in range(0x110000)])


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 1- to 3-grams of the texts, as 63-bit numbers, and the position of each gram's text."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, 0).astype(np.int64)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 1 for t in lowered])
    text = np.concatenate([text[:1], text])
    ones = np.flatnonzero(codes)
    a, b = codes[:-1], codes[1:]
    twos = np.flatnonzero((a > 0) | (b > 0))
    x, y, z = codes[:-2], codes[1:-1], codes[2:]
    threes = np.flatnonzero(y > 0)
    grams = [
        (ONE << 2 * CODE_BITS) | codes[ones],
        (TWO << 2 * CODE_BITS) | (a[twos] << CODE_BITS) | b[twos],
        (x[threes] << 2 * CODE_BITS) | (y[threes] << CODE_BITS) | z[threes],
    ]
    at_two = np.where(a[twos] > 0, text[twos], text[twos + 1])
    return np.concatenate(grams), np.concatenate([text[ones], at_two, text[threes + 1]])


def counted(owner: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, gram) in order, with their counts."""
    seen, at = np.unique(grams, return_inverse=True)
    width = max(1, len(seen))
    pairs, counts = np.unique(owner * width + at, return_counts=True)
    return pairs // width, seen[pairs % width] if len(seen) else seen, counts


@dataclass(frozen=True)
class Profiles:
    """Ranks of every n-gram (columns, in order) in every language (rows); ``PROFILE`` where it has none."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (language number, gram) summed, in order."""
    owner, grams, counts = (np.concatenate(columns) for columns in zip(*parts))
    order = np.lexsort((grams, owner))
    owner, grams, counts = owner[order], grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])]))
    return owner[first], grams[first], np.add.reduceat(counts, first)


def _count_step(language: str, text: str):
    def told(held: tuple[np.ndarray, np.ndarray, np.ndarray], names: list[str]) -> pa.RecordBatch:
        owner, grams, counts = held
        language = pa.DictionaryArray.from_arrays(pa.array(owner, pa.int32()), pa.array(names, pa.string()))
        return pa.RecordBatch.from_pydict({"language": language.cast(pa.string()), "gram": pa.array(grams), "n": pa.array(counts)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in slices(batches):
            number = np.array([numbers.setdefault(n, len(numbers)) for n in batch.column(language).to_pylist()], np.int32)
            grams, texts = grams_of([t or "" for t in batch.column(text).to_pylist()])
            if not len(grams):
                continue
            held.append(_merged([(number[texts], grams, np.ones(len(grams), np.int64))]))
            size += len(held[-1][1])
            if size > HELD_GRAMS:
                held = [_merged(held)]
                size = len(held[0][1])
                if size > HELD_GRAMS // 2:
                    yield told(held[0], list(numbers))
                    held, size = [], 0
        if held:
            yield told(_merged(held), list(numbers))

    return run


def gram_counts(df: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """How often each language's rows hold each n-gram: ``language``, ``gram``, ``n``."""
    rows = df.select(F.col(language).alias("language"), F.col(text).alias("text")).dropna()
    counts = rows.mapInArrow(_count_step("language", "text"), "language string, gram bigint, n bigint")
    return counts.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, language: str = "lang", text: str = "text") -> Profiles:
    """The profile of every language in ``df``."""
    order = [F.desc("n"), F.col("gram")]
    salted = Window.partitionBy("language", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("language").orderBy(*order)
    counts = gram_counts(df, language, text)
    short = counts.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= PROFILE)
    best = short.withColumn("rank", F.row_number().over(whole) - 1).filter(F.col("rank") < PROFILE)
    rows = best.select("language", "gram", "rank").limit(MAX_LANGUAGES * PROFILE + 1).collect()
    if len(rows) > MAX_LANGUAGES * PROFILE:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; they are to be few, as profiles go to every task")
    languages = sorted({r.language for r in rows})
    grams = np.array(sorted({r.gram for r in rows}), np.int64)
    ranks = np.full((len(languages), len(grams)), PROFILE, np.int32)
    at = {name: i for i, name in enumerate(languages)}
    if rows:
        ranks[[at[r.language] for r in rows], np.searchsorted(grams, [r.gram for r in rows])] = [r.rank for r in rows]
    return Profiles(languages, grams, ranks)


def nearest(texts: list[str], profiles: Profiles) -> tuple[list[str], list[float]]:
    """The language of the least out-of-place distance for each text, and its score."""
    owner, keys, counts = counted(*reversed(grams_of(texts)))
    if not len(keys) or not profiles.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    order = np.lexsort((keys, -counts, owner))
    owner, keys = owner[order], keys[order]
    first = np.searchsorted(owner, np.arange(len(texts)))
    rank = np.arange(len(owner)) - first[owner]
    top = rank < PROFILE
    owner, keys, rank = owner[top], keys[top], rank[top]
    at = np.minimum(np.searchsorted(profiles.grams, keys), len(profiles.grams) - 1)
    known = profiles.grams[at] == keys
    sums = np.empty((len(profiles.languages), len(texts)))
    for i, ranks in enumerate(profiles.ranks):
        there = np.where(known, ranks[at], PROFILE)
        apart = np.where(there < PROFILE, np.abs(there - rank), PROFILE)
        sums[i] = np.bincount(owner, weights=apart, minlength=len(texts))
    sizes = np.bincount(owner, minlength=len(texts))
    best = np.argmin(sums, axis=0)
    least = sums[best, np.arange(len(texts))] / np.maximum(1, sizes * PROFILE)
    names = [profiles.languages[b] if size else UNKNOWN for b, size in zip(best, sizes)]
    return names, np.where(sizes > 0, np.round(1 - least, 6), 0.0).tolist()


def _predict_step(profiles: Profiles, text: str, named: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = nearest([t or "" for t in batch.column(text).to_pylist()], profiles)
            made = {named[0]: pa.array(names, pa.string()), named[1]: pa.array(scores, pa.float64())}
            yield with_columns(batch, made)

    return run


def predict(
    df: DataFrame, profiles: Profiles, text: str = "text", named: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Add the language and its score to every row, from its text alone, under the two names given."""
    added = f"{named[0]} string, {named[1]} double"
    return through(df, [_predict_step(profiles, text, named)], schema_with(df, added))


def least_scores(told: DataFrame, language: str, text: str, predicted: str, score: str) -> DataFrame:
    """``name``, ``length`` and ``bound``: the least score of clean texts of each language and class of length.

    A class holds texts up to twice as long as its shortest. The bound is ``MARGIN`` of a low quantile of the labelled rows that
    were recognised; a class of few such rows has none of its own. ``length`` is null for a language's whole.
    """
    sized = told.filter(F.col(language) == F.col(predicted)).select(
        F.col(predicted).alias("name"), F.length(F.bin(F.length(text))).alias("length"), F.col(score).alias("score")
    )
    low = F.percentile_approx("score", F.lit(LOW), F.lit(10_000))
    sums = sized.rollup("name", "length").agg((low * MARGIN).alias("bound"), F.count(F.lit(1)).alias("n"))
    return sums.filter(F.col("name").isNotNull() & (F.col("length").isNull() | (F.col("n") >= CLASS_ROWS))).drop("n")


def in_known_language(df: DataFrame, least_score: float, language: str = "lang", text: str = "text") -> DataFrame:
    """The rows that resemble a language learned from ``df`` itself.

    ``und`` goes, and what scores below the bound of its language and length (``least_scores``), or ``least_score``.
    Where no row has a language, nothing is known to compare with: then only null texts and texts without letters go.
    """
    predicted, score, name, length, bound, whole = (f"_{n}_{uuid.uuid4().hex}" for n in ("language", "score", "name", "length", "bound", "whole"))
    profiles = learn(df, language, text)
    if not profiles.languages:
        return df.filter(F.col(text).rlike(r"\p{L}"))
    # scored again for the rows that stay: a table of all texts with their scores would outlive this stage
    told = predict(df, profiles, text, (predicted, score))
    bounds = cut_lineage(least_scores(told, language, text, predicted, score))
    by_class = bounds.filter("length is not null").toDF(name, length, bound)
    by_language = bounds.filter("length is null").select(F.col("name").alias(f"{name}w"), F.col("bound").alias(whole))
    same = (F.col(predicted) == F.col(name)) & (F.length(F.bin(F.length(F.col(text)))) == F.col(length))
    judged = told.filter(F.col(predicted) != UNKNOWN).join(F.broadcast(by_class), same, "left")
    judged = judged.join(F.broadcast(by_language), F.col(predicted) == F.col(f"{name}w"), "left")
    least = F.greatest(F.coalesce(F.col(bound), F.col(whole)), F.lit(least_score))
    return judged.filter(F.col(score) >= least).select(*(F.col(f"`{c}`") for c in df.columns))
