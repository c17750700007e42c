"""SQL fragments the text twins share."""

from __future__ import annotations

from collections.abc import Sequence

from folioscope.functions.words import DROPPED_TOKENS, FUNCTION_WORDS, phrase_breakers


def quoted(words: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def ascii_of(column: str) -> str:
    return f"regexp_replace({column}, '[^\\x00-\\x7F]', '', 'g')"


def clean_of(column: str) -> str:
    inner = (
        f"replace(replace(replace(replace({ascii_of(column)}, '\"', ''), '''', ''), '\\', '-'), chr(10), ' ')"
    )
    return f"regexp_replace({inner}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"


def tokens_of(column: str) -> str:
    return f"regexp_extract_all(lower({ascii_of(column)}), '[a-z0-9]+(?:-[a-z0-9]+)*|[^a-z0-9\\s]', 0)"


def bare(word: str) -> str:
    return f"regexp_replace({word}, '[!-/:-@\\[-`{{-~]', '', 'g')"


STOPS = quoted(phrase_breakers())
EXCLUDED = quoted([*FUNCTION_WORDS, *DROPPED_TOKENS])


def token_rows(source: str, key: str = "doc_id", column: str = "text") -> str:
    """CTEs ``toks`` and ``tok``: one row per raw token with its position."""
    return f"""
toks AS (SELECT {key}, {tokens_of(column)} AS ts FROM {source}),
tok AS (SELECT {key}, unnest(ts) AS w, unnest(range(1, len(ts) + 1)) AS pos FROM toks)"""


def filtered_rows(source: str, key: str = "doc_id", column: str = "text") -> str:
    """CTE ``term_rows``: one row per content word."""
    return f"""{token_rows(source, key, column)},
bare_rows AS (SELECT {key}, pos, {bare('w')} AS term FROM tok),
term_rows AS (
  SELECT {key}, pos, term FROM bare_rows
  WHERE length(term) BETWEEN 2 AND 40 AND term NOT IN ({EXCLUDED}) AND NOT regexp_matches(term, '^[0-9]+$'))"""


def phrase_rows(source: str, key: str = "doc_id", column: str = "text", max_words: int = 5) -> str:
    """CTE ``phr``: one row per phrase occurrence."""
    return f"""{token_rows(source, key, column)},
marked AS (
  SELECT {key}, pos, w,
         (w IN ({STOPS}) OR regexp_matches(w, '[0-9]') OR regexp_matches(w, '^[^a-z0-9]$')) AS brk
  FROM tok),
runs AS (
  SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos) AS run FROM marked),
phr AS (
  SELECT {key}, run, string_agg(w, ' ' ORDER BY pos) AS phrase, count(*) AS n_words
  FROM runs WHERE NOT brk GROUP BY {key}, run HAVING count(*) <= {max_words})"""


def score_rows(keys: str) -> str:
    """CTE ``scored`` from ``phr`` grouped by ``keys``."""
    using = ", ".join([*[k.strip() for k in keys.split(",")], "word"])
    return f"""
words AS (SELECT {keys}, phrase, n_words, unnest(string_split(phrase, ' ')) AS word FROM phr),
word_scores AS (SELECT {keys}, word, sum(n_words) AS ws FROM words GROUP BY {keys}, word),
distinct_phr AS (SELECT DISTINCT {keys}, phrase FROM phr),
phrase_words AS (SELECT {keys}, phrase, unnest(string_split(phrase, ' ')) AS word FROM distinct_phr),
scored AS (
  SELECT {keys}, phrase, CAST(sum(ws) AS BIGINT) AS score
  FROM phrase_words JOIN word_scores USING ({using}) GROUP BY {keys}, phrase)"""
