"""SQL twins of the queries, for DuckDB over the same tables, and the parameters both sides share."""

from __future__ import annotations

from folioscope.llm.templates import LICENSES

# The url rules of the registered query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

URL_FILTERS = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
rests AS (
  SELECT row_number() OVER () AS row, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT row, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM rests),
met AS (
  SELECT parts.*, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM parts LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM met WHERE place = 1
"""


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _runs(words: str, size: int) -> str:
    return f"list_transform(range(1, len({words}) - {size - 2}), lambda i: array_to_string({words}[i:i + {size - 1}], ' '))"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


LICENSE_SCANS = f"""
WITH listed(license_id, text) AS (VALUES {", ".join(f"({_text(i)}, {_text(t)})" for i, t in LICENSES)}),
template_words AS (SELECT license_id, {_words('text')} AS ws FROM listed),
template_sets AS (
  SELECT license_id, row_number() OVER () AS template, list_distinct({_runs('ws', 2)}) AS bs
  FROM (SELECT DISTINCT license_id, ws FROM template_words) WHERE len(ws) >= 2),
template_rows AS (SELECT license_id, template, len(bs) AS size, unnest(bs) AS bigram FROM template_sets),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
units AS (
  SELECT row, doc_id, unnest(string_split(text, chr(10))) AS unit,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line
  FROM docs
  UNION ALL
  SELECT row, doc_id, text, 0 FROM docs WHERE contains(text, chr(10))),
unit_words AS (SELECT row, doc_id, line, {_words('unit')} AS ws FROM units),
unit_sets AS (SELECT row, doc_id, line, list_distinct({_runs('ws', 2)}) AS bs FROM unit_words WHERE len(ws) >= 2),
unit_rows AS (SELECT row, doc_id, line, len(bs) AS unit_size, unnest(bs) AS bigram FROM unit_sets),
counts AS (
  SELECT doc_id, line, license_id, unit_size, size, count(*) AS n_shared
  FROM unit_rows JOIN template_rows USING (bigram) GROUP BY row, doc_id, line, license_id, template, unit_size, size)
SELECT doc_id, line::INT AS line, license_id, n_shared, 2.0::DOUBLE * n_shared / (unit_size + size) AS dice
FROM counts WHERE 2.0::DOUBLE * n_shared / (unit_size + size) >= 0.8
"""

DECONTAMINATION = f"""
WITH doc_words AS (SELECT row_number() OVER () AS row, doc_id, {_words('text')} AS ws FROM documents),
doc_rows AS (SELECT row, doc_id, unnest(list_distinct({_runs('ws', 5)})) AS shingle FROM doc_words WHERE len(ws) >= 5),
item_words AS (SELECT DISTINCT item_id, {_words('text')} AS ws FROM benchmark),
item_sets AS (
  SELECT item_id, row_number() OVER () AS item, list_distinct({_runs('ws', 5)}) AS shingles
  FROM item_words WHERE len(ws) >= 5),
item_rows AS (SELECT item_id, item, len(shingles) AS n_shingles, unnest(shingles) AS shingle FROM item_sets),
counts AS (
  SELECT doc_id, item_id, n_shingles, count(*) AS n_shared FROM doc_rows JOIN item_rows USING (shingle)
  GROUP BY row, doc_id, item, item_id, n_shingles)
SELECT doc_id, item_id, n_shingles::INT AS n_shingles, n_shared::INT AS n_shared,
       n_shared::DOUBLE / n_shingles AS containment
FROM counts WHERE 10 * n_shared >= 8 * n_shingles
"""


def _root(text: str) -> str:
    paragraphs = "list_transform(string_split(s, chr(10)), lambda p: sha256('paragraph ' || p))"
    sections = (
        f"list_transform(string_split({text}, chr(10) || chr(10)), "
        f"lambda s: sha256('section ' || array_to_string({paragraphs}, '')))"
    )
    return f"sha256('document ' || array_to_string({sections}, ''))"


def _twigs(text: str) -> str:
    return f"list_distinct(regexp_extract_all({text}, '(?:[^ \\n]+ *){{1,4}}'))"


def _likeness(a: str, b: str, root_a: str, root_b: str) -> str:
    return (
        f"CASE WHEN {root_a} = {root_b} THEN 1.0::DOUBLE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE "
        f"ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"
    )


FINGERPRINTS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
following AS (
  SELECT doc_id, t, length(t) AS n,
         coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt
  FROM docs),
edited AS (SELECT *, substr(t, 1, n - n // 3) || substr(nt, 1, n // 3) AS e FROM following),
hashed AS (
  SELECT doc_id, n, e, {_root('t')} AS f, {_root('e')} AS ef, {_root('nt')} AS nf,
         {_twigs('t')} AS tw, {_twigs('e')} AS etw, {_twigs('nt')} AS ntw
  FROM edited)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, f AS fingerprint, ef AS edited_fingerprint,
       {_likeness('tw', 'etw', 'f', 'ef')} AS near_edited, {_likeness('tw', 'ntw', 'f', 'nf')} AS near_next
FROM hashed
"""
