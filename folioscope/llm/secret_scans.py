"""Secret scans: fixed patterns, and credential values that are costly to guess.

Fixed patterns find assignments to credential names, cloud access keys and long hexadecimal runs. Beyond
these, a value that stands in a credential context (a wider set of names, followed by ``:``, ``=``, ``->`` or
``is``) is reported as ``guess`` if guessing it is costly. The cost comes from dynamic programming over the
value: the cheapest cut into dictionary words (by list position, with the usual letter substitutes; passwords and function
words, then the whole words of public vocabularies, most frequent first), dates, repeats, keyboard walks and brute-force characters, as decimal logarithms of guesses that add up along the
value. A guessed value that overlaps a span of a fixed pattern is not reported again.

Spans count code points, ends exclusive. A null text counts as empty and has no spans. Texts and values are
used whole; the programming is linear in the value's length. Every row is scanned for itself, repeated or
not; other columns stay, except those the result replaces by name.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from folioscope.functions.words import FUNCTION_WORDS
from folioscope.llm.batches import schema_with, through, with_columns

KINDS = ("assign", "access", "hex", "guess")
#: A value is a secret from this many guesses on (decimal logarithm).
MIN_GUESSES = 8.0

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_LENGTH = 6
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")

CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?i:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|"""
    r"""(?:api|access|private|secret|client)[_ -]?(?:key|secret|token))["'`]?[ \t]*(?:[:=]>?|->|\bis\b)[ \t]*["'`]?"""
    r"""(?:(?i:bearer|basic)[ \t]+)?([^\s"'`<>]{6,})""",
    re.ASCII,
)
#: A text without any of these, in lower case, has no credential context.
CUES = ("pass", "passwd", "pwd", "pin", "secret", "token", "credential", "auth", "bearer", "key")
ASSIGN_CUES = ("passw", "secret", "token", "api")
TRAILING = ".,;:!?)]}"

# Often used passwords, most frequent first.
COMMON = tuple(
    """
    password admin welcome qwerty letmein monkey dragon master login princess sunshine football baseball shadow
    superman batman trustno iloveyou starwars hello freedom whatever secret summer winter spring autumn love test
    guest root user changeme default access pass internet computer michael jennifer thomas jordan hunter killer
    soccer hockey george charlie andrew michelle jessica pepper ginger cheese cookie purple orange silver golden
    """.split()
)
# The rows of a keyboard, along which walks run.
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
# Signs that stand for letters.
SUBSTITUTES = str.maketrans("@4301!$57", "aaeoiisst")

WORD_COST = {word: math.log10(place + 2) for place, word in reversed([*enumerate((*COMMON, *FUNCTION_WORDS))])}
#: Public vocabularies in order of frequency, and the one that marks word ends instead of starts; shorter words are left out.
RANKED, ENDED, LEAST_LETTERS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"), "word_bpe_49k.json", 4
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
YEARS, DAYS, SEPARATORS = 120, 365, 4


def _public_words() -> Iterator[tuple[int, str]]:
    """Place and text of the whole words in the public vocabularies."""
    for name in RANKED:
        with open(public_tokenizers.path(name), "rb") as lines:
            for place, line in enumerate(lines):
                token = base64.b64decode(line.split()[0]).decode(errors="replace")
                if token.startswith(" "):
                    yield place, token[1:].lower()
    with open(public_tokenizers.path(ENDED), encoding="utf-8") as file:
        for token, place in json.load(file)["model"]["vocab"].items():
            if token.endswith("</w>"):
                yield place, token.removesuffix("</w>")


@dataclass(frozen=True)
class Words:
    """Costs of dictionary words by 64-bit hashes, in order, so that a worker needs 16 bytes a word."""

    hashes: array
    costs: array
    longest: int

    def cost(self, word: str) -> float:
        key = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        at = bisect.bisect_left(self.hashes, key)
        return self.costs[at] if at < len(self.hashes) and self.hashes[at] == key else math.inf


@functools.lru_cache(maxsize=1)
def dictionary() -> Words:
    """The dictionary, read from the public vocabularies; the driver sends it with its tasks."""
    places: dict[str, int] = {}
    for place, word in _public_words():
        if len(word) >= LEAST_LETTERS and word.isalpha() and word not in WORD_COST:
            places[word] = min(place, places.get(word, place))
    ranked = sorted(places, key=lambda w: (places[w], w))
    costs = {word: math.log10(place + 2) for place, word in enumerate(ranked, len(WORD_COST))} | WORD_COST
    rows = sorted((xxhash.xxh64_intdigest(word.encode()), cost) for word, cost in costs.items())
    return Words(array("Q", [h for h, _ in rows]), array("d", [c for _, c in rows]), max(map(len, costs)))


def _neighbours() -> set[tuple[str, str]]:
    steps = {(a, b) for row in KEY_ROWS for a, b in zip(row, row[1:])}
    return steps | {(b, a) for a, b in steps}


NEIGHBOURS = _neighbours()


def guess_cost(value: str, words: Words | None = None) -> float:
    """Decimal logarithm of the guesses for ``value``: the least sum of costs over all ways to cut it."""
    size = len(value)
    lowered = value.lower() if len(value.lower()) == size else value
    plain = lowered.translate(SUBSTITUTES)
    dates: dict[int, list[int]] = {}
    for start in range(size):
        if value[start].isdigit() and (found := DATE.match(value, start)):
            dates.setdefault(found.end(), []).append(start)
    words = words or dictionary()
    best = [0.0] + [math.inf] * size
    walk = run = 1
    for end in range(1, size + 1):
        best[end] = best[end - 1] + 1.0
        for start in range(max(0, end - words.longest), end - 1):
            cost = min(words.cost(lowered[start:end]), words.cost(plain[start:end]) + math.log10(2))
            if value[start:end] != lowered[start:end]:
                cost += math.log10(2)
            best[end] = min(best[end], best[start] + cost)
        for start in dates.get(end, ()):
            best[end] = min(best[end], best[start] + math.log10(YEARS * (DAYS * SEPARATORS if end - start > 4 else 1)))
        if end > 1:
            run = run + 1 if value[end - 1] == value[end - 2] else 1
            walk = walk + 1 if (lowered[end - 2], lowered[end - 1]) in NEIGHBOURS else 1
            if run >= 3:
                best[end] = min(best[end], best[end - run] + 1.0 + math.log10(run))
            if walk >= 3:
                best[end] = min(best[end], best[end - walk] + math.log10(2 * len(NEIGHBOURS) * walk))
        for width in (2, 3, 4):
            if end >= 2 * width and value[end - width : end] == value[end - 2 * width : end - width]:
                best[end] = min(best[end], best[end - width] + math.log10(2))
    return best[size]


def scan(text: str, min_guesses: float = MIN_GUESSES, words: Words | None = None) -> list[tuple[str, int, int, int, float]]:
    """Spans of one text by start, then kind: kind, start, end, start of the value, cost of the value."""
    lowered = text.lower()
    spans = []
    if any(cue in lowered for cue in ASSIGN_CUES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LENGTH:
                spans.append(("assign", m.start(), m.end(), m.start(2), guess_cost(m[2], words)))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), m.start(), guess_cost(m[0], words)) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end(), m.start(), guess_cost(m[0], words)) for m in HEX.finditer(text)]
    if any(cue in lowered for cue in CUES):
        taken = sorted((start, end) for _, start, end, _, _ in spans)
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(TRAILING)
            start, end = m.start(1), m.start(1) + len(value)
            if len(value) < ASSIGN_LENGTH or any(a < end and start < b for a, b in taken):
                continue
            if (cost := guess_cost(value, words)) >= min_guesses:
                spans.append(("guess", start, end, start, cost))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


SPAN_TYPE = pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("cost", pa.float64())]
)
SPANS = "secrets array<struct<kind:string,start:int,end:int,value_start:int,cost:double>>"


def _scan_step(text: str, min_guesses: float):
    words = dictionary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.name for field in SPAN_TYPE]
        for batch in batches:
            found = [
                [dict(zip(names, span)) for span in scan(t or "", min_guesses, words)] for t in batch.column(text).to_pylist()
            ]
            yield with_columns(batch, {"secrets": pa.array(found, pa.list_(SPAN_TYPE))})

    return run


def find_secrets(df: DataFrame, text: str = "text", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """Add the array ``secrets`` of spans to every row."""
    return through(df, [_scan_step(text, min_guesses)], schema_with(df, SPANS))


def redacted(text: str, spans: list[tuple[str, int, int, int, float]], mark: str = "[SECRET]") -> str:
    """``text`` with the value of every span replaced by ``mark``; overlapping values by a single one."""
    parts, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in spans):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _redact_step(text: str, min_guesses: float):
    words = dictionary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [t if t is None else redacted(t, scan(t, min_guesses, words)) for t in batch.column(text).to_pylist()]
            columns = {name: batch.column(name) for name in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {text: pa.array(kept, pa.string())})

    return run


def redact(df: DataFrame, text: str = "text", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """Replace the value of every secret in ``text``; all rows and columns stay."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return through(df, [_redact_step(text, min_guesses)], fields)


def digest(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind and the digests of spans, in the order of the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("secrets").to_pylist()
            told = [[(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans] for spans in rows]
            base = [",".join(t for kind, t in spans if kind != "guess") for spans in told]
            counts = {f"n_{k}": pa.array([sum(kind == k for kind, _ in s) for s in told], pa.int64()) for k in KINDS[:3]}
            yield pa.RecordBatch.from_pydict(
                {id_column: batch.column(id_column)}
                | counts
                | {
                    "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                    "spans": pa.array([",".join(t for _, t in s) for s in told], pa.string()),
                }
            )

    kind = dict(df.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return through(df.select(id_column, text), [_scan_step(text, MIN_GUESSES), run], schema)
