"""Text columns: cleaning, tokens, sentences and token predicates. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.words import DROPPED_TOKENS, FUNCTION_WORDS

# Patterns of the tokenizer. A token is a word with inner hyphens, or one other character.
NON_ASCII = r"[^\x00-\x7F]"
WORD = r"[a-z0-9]+(?:-[a-z0-9]+)*"
TOKEN = WORD + r"|[^a-z0-9\s]"
EDGE_BLANKS = r"^[ \t\n\r\f]+|[ \t\n\r\f]+$"
MARKUP = r"<[^>]*>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SENTENCE_ENDS = (".", "?", "!")


def strip_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, NON_ASCII, "")


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_BLANKS, "")


def clean_raw_text(text: Column) -> Column:
    """ASCII only, quotes dropped, backslash to hyphen, newline to blank, edges trimmed."""
    return strip_blanks(F.translate(strip_non_ascii(text), "\\\n\"'", "- "))


def strip_markup(text: Column, strict: bool = False) -> Column:
    """Drop inner tags; ``strict`` keeps only the text before the first tag."""
    return F.regexp_extract(text, r"^[^<]*", 0) if strict else F.regexp_replace(text, MARKUP, "")


def tokens(text: Column) -> Column:
    """Lower-case tokens of the ASCII part of a text, in order."""
    return F.regexp_extract_all(F.lower(strip_non_ascii(text)), F.lit(TOKEN), F.lit(0))


def strip_punctuation(word: Column) -> Column:
    return F.translate(word, PUNCTUATION, "")


def is_digits(word: Column) -> Column:
    return word.rlike(r"^[0-9]+$")


def contains_digit(word: Column) -> Column:
    return word.rlike(r"[0-9]")


def is_punct(word: Column) -> Column:
    """One character that is an ASCII punctuation mark."""
    return word.rlike(r"^[!-/:-@\[-`{-~]$")


def is_numeric(word: Column) -> Column:
    """An optionally signed integer or decimal, blanks around it allowed."""
    return word.rlike(r"^\s*[+-]?([0-9]+|[0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$") & (
        ~word.rlike(r"[eE]") | word.contains(".")
    )


def tokens_filtered(
    text: Column,
    stop_words: Sequence[str] = FUNCTION_WORDS,
    dropped: Sequence[str] = DROPPED_TOKENS,
    shortest: int = 2,
    longest: int = 40,
) -> Column:
    """Content words: punctuation stripped, stop words, digits and odd lengths dropped."""
    if shortest < 2:
        words = F.transform(tokens(text), strip_punctuation)
    else:
        # tokens of one character are dropped anyway, and a word has no punctuation but hyphens
        words = F.regexp_extract_all(F.lower(strip_non_ascii(text)), F.lit(WORD), F.lit(0))
        words = F.transform(words, lambda w: F.replace(w, F.lit("-"), F.lit("")))
    excluded = [*stop_words, *dropped]
    # what begins with a letter is no number, which saves the pattern
    return F.filter(
        words,
        lambda w: F.length(w).between(shortest, longest) & ~w.isin(excluded) & ((w >= "a") | ~is_digits(w)),
    )


def tokens_simple(text: Column, dropped: Sequence[str] = DROPPED_TOKENS, longest: int = 40) -> Column:
    """All words of a text as one string, sentence ends kept as a full stop after the word."""
    words = F.transform(
        tokens(text), lambda w: F.when(w.isin(list(SENTENCE_ENDS)), F.lit(".")).otherwise(strip_punctuation(w))
    )
    kept = F.filter(words, lambda w: F.length(w).between(1, longest) & ~is_digits(w) & ~w.isin(list(dropped)))
    return F.replace(F.array_join(kept, " "), F.lit(" ."), F.lit("."))


def ngrams(words: Column, sizes: Sequence[int]) -> Column:
    """All runs of the given numbers of words, joined by blanks. ``words`` is to be a plain column."""

    def of(size: int) -> Column:
        none = F.array().cast("array<string>")
        starts = F.sequence(F.lit(0), F.size(words) - size)
        runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))
        return F.when(F.size(words) >= size, words if size == 1 else runs).otherwise(none)

    return F.concat(*[of(size) for size in sizes])


def sentences(text: Column) -> Column:
    """Sentences of a text: cut at end marks, trimmed, blank ones dropped."""
    parts = F.transform(F.split(text, r"[.?!]"), strip_blanks)
    return F.filter(parts, lambda s: F.length(s) > 0)


def digits_of(text: Column) -> Column:
    """Every digit of a string; a range of years gives eight digits."""
    return F.regexp_replace(text, r"[^0-9]", "")


def substring_count(text: Column, needle: Column) -> Column:
    """Number of non-overlapping occurrences; an empty needle counts as absent."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    found = (F.length(needle) > 0) & text.contains(needle)
    return F.when(found, F.floor(removed / F.length(needle))).otherwise(F.lit(0)).cast("bigint")


def html_escape(text: Column) -> Column:
    """Escape the six characters that matter in markup; the ampersand goes first."""
    # The characters and their escapes.
    escapes = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")]
    for raw, escaped in escapes:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def normalize_entry(entry: Column, drop_punctuation: bool) -> Column:
    """One keyword or subject heading as a single lower-case word joined by underscores."""
    trimmed = strip_blanks(strip_non_ascii(entry))
    if drop_punctuation:
        trimmed = strip_punctuation(trimmed)
    return F.lower(F.translate(trimmed, " \\", "_-"))
