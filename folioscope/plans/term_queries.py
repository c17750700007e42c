"""Term matrices, weights, similarity between documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import embedding as E
from folioscope.operators import stemming as ST
from folioscope.operators import terms as M
from folioscope.plans import sqltext as S
from folioscope.plans.registry import query, spread_texts, table, texts

# Document attributes drawn from the tables: a priced order stands for a document, its parts' brands are
# keywords, its suppliers authors, its part types subject headings and its priority the publication type.
ATTRIBUTES = """attrs AS (
  SELECT l_orderkey AS doc_id, p_brand AS keyword, 'supp' || l_suppkey AS author, lower(p_type) AS term
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def attribute_docs(spark, sf_dir):
    """Per order: arrays of brands, suppliers and part types."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("p_brand").alias("keyword"),
        F.concat(F.lit("supp"), F.col("l_suppkey")).alias("author"),
        F.lower("p_type").alias("term"),
    )


def document_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents"), M.token_rows(spread_texts(spark, sf_dir))


COUNTS = f"""{S.filtered_rows('documents')},
counts AS (SELECT doc_id, term, count(*) AS tf FROM term_rows GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term)"""


@query(
    "term_counts",
    f"""WITH {COUNTS}
    SELECT doc_id, term, tf FROM counts JOIN dfs USING (term)
    WHERE df >= 2 AND df <= 0.5 * (SELECT count(*) FROM documents)""",
)
def term_counts(spark, sf_dir):
    docs, rows = document_rows(spark, sf_dir)
    return M.term_counts(rows, docs)


TFIDF = f"""{COUNTS},
weighted AS (
  SELECT doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w
  FROM counts JOIN dfs USING (term), (SELECT count(*)::DOUBLE AS n FROM documents)
  WHERE df >= 2 AND df <= 0.4 * n),
tfidf AS (
  SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM weighted)"""


@query("tfidf", f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf")
def tfidf(spark, sf_dir):
    docs, rows = document_rows(spark, sf_dir)
    return M.tfidf(rows, docs).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "attribute_counts",
    f"""WITH {ATTRIBUTES},
    rows_ AS (
      SELECT 'author' AS block, doc_id, author AS entry, 3 AS lo FROM attrs
      UNION ALL SELECT 'keyword', doc_id, keyword, 1 FROM attrs
      UNION ALL SELECT 'term', doc_id, term, 1 FROM attrs),
    counts AS (SELECT block, doc_id, entry, lo, count(*) AS tf FROM rows_ GROUP BY ALL),
    dfs AS (SELECT block, entry, count(*) AS df FROM counts GROUP BY ALL)
    SELECT block, doc_id, entry AS term, tf FROM counts JOIN dfs USING (block, entry)
    WHERE df >= lo AND df <= 0.9 * (SELECT count(DISTINCT doc_id) FROM attrs)""",
)
def attribute_counts(spark, sf_dir):
    attrs = attribute_docs(spark, sf_dir)
    docs = attrs.select("doc_id").distinct()
    blocks = {}
    for name, min_df in (("author", 3), ("keyword", 1), ("term", 1)):
        rows = attrs.select("doc_id", F.col(name).alias("term"))
        counts = M.term_counts(rows, docs, min_df=min_df, max_df=0.9)
        blocks[name] = counts.select("doc_id", "term", F.col("tf").alias("weight"))
    return M.hstack_features(blocks).withColumnRenamed("weight", "tf")


@query(
    "hstack_features",
    f"""WITH {TFIDF},
    src AS (SELECT doc_id, 'source' AS block, source AS term, 1.0::DOUBLE AS weight FROM documents)
    SELECT 'text' AS block, doc_id, term, round(weight, 6) AS weight FROM tfidf
    UNION ALL SELECT block, doc_id, term, weight FROM src""",
)
def hstack_features(spark, sf_dir):
    docs, rows = document_rows(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("term"), F.lit(1.0).alias("weight")
    )
    stacked = M.hstack_features({"text": M.tfidf(rows, docs), "source": sources})
    return stacked.withColumn("weight", F.round("weight", 6))


@query(
    "vocab_lookup",
    f"""WITH {COUNTS}
    SELECT t.doc_id, count(*) AS known FROM term_rows t
    WHERE t.term IN (SELECT term FROM dfs WHERE df >= 2 AND df <= 0.5 * (SELECT count(*) FROM documents))
    GROUP BY t.doc_id""",
)
def vocab_lookup(spark, sf_dir):
    docs, rows = document_rows(spark, sf_dir)
    counts = M.raw_counts(rows)
    vocab = M.vocabulary(counts, M.count_rows(docs), 2, 0.5)
    # restrict the counts, one row per distinct word of a document, then add them up
    return M.vocab_lookup(counts, vocab).groupBy("doc_id").agg(F.sum("tf").alias("known"))


MIN_SIM = 0.5


def pairs_and_copies(pairs, members):
    """Pairs of representatives, and for every other document the representative whose vector it has."""
    copies = members.filter("doc_id <> rep").select(
        F.lit("copy").alias("kind"), F.col("rep").alias("i"), F.col("doc_id").alias("j"), F.lit(None).cast("double").alias("sim")
    )
    return pairs.select(F.lit("pair").alias("kind"), "i", "j", F.round("sim", 6).alias("sim")).unionByName(copies)


VECTORS = f"""{TFIDF},
signed AS (SELECT doc_id, string_agg(term || '=' || round(weight, 9)::VARCHAR, ',' ORDER BY term) AS sig
           FROM tfidf GROUP BY doc_id),
reps AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS rep FROM signed)"""


@query(
    "cosine_pairs",
    f"""WITH {VECTORS},
    v AS (SELECT doc_id, term, round(weight, 9) AS weight FROM tfidf
          WHERE doc_id IN (SELECT rep FROM reps)),
    pairs AS (
      SELECT a.doc_id AS i, b.doc_id AS j, sum(a.weight * b.weight) AS sim
      FROM v a JOIN v b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2)
    SELECT 'pair' AS kind, i, j, round(sim, 6) AS sim FROM pairs WHERE round(sim, 6) >= {MIN_SIM}
    UNION ALL SELECT 'copy', rep, doc_id, NULL FROM reps WHERE doc_id <> rep""",
)
def cosine_pairs(spark, sf_dir):
    docs, rows = document_rows(spark, sf_dir)
    return pairs_and_copies(*M.cosine_pairs(M.tfidf(rows, docs), MIN_SIM))


@query("cosine_copies", f"WITH {VECTORS} SELECT doc_id, rep FROM reps")
def cosine_copies(spark, sf_dir):
    docs, rows = document_rows(spark, sf_dir)
    return M.vector_copies(M.tfidf(rows, docs))


@query(
    "corpus_flags",
    """WITH d AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS numbers,
      regexp_extract_all(text, '[^ ]+@[^ ]+') AS mails FROM documents)
    SELECT count(*) FILTER (len(numbers) > 0) AS n_numbers, count(*) FILTER (len(mails) > 0) AS n_mails FROM d""",
)
def corpus_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("numbers"),
        F.regexp_extract_all("text", F.lit("[^ ]+@[^ ]+"), F.lit(0)).alias("mails"),
    )
    return M.corpus_flags(docs, ["numbers", "mails"])


FIRST_LINE = "title_docs AS (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents)"


def _unit_twin(name: str, source: str) -> str:
    """CTEs that end in ``name``: TF-IDF unit vectors of the texts in ``source``."""
    body = TFIDF.replace("FROM documents)", f"FROM {source})")
    for cte in ("toks", "tok", "bare_rows", "term_rows", "counts", "dfs", "weighted", "tfidf"):
        body = re.sub(rf"\b{cte}\b", f"{name}_{cte}", body)
    return body


COMBINED_MIN = 1.6
MAIL = "[a-z0-9.]+@[a-z0-9.]+"


@query(
    "combined_similarity",
    f"""WITH {FIRST_LINE}, {_unit_twin('title', 'title_docs')}, {_unit_twin('abstract', 'documents')},
    found AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '{MAIL}')) AS mails FROM documents),
    authors AS (SELECT doc_id, unnest(mails) AS author, len(mails) AS n FROM found),
    cells AS (
      SELECT doc_id, 'title|' || term AS term, weight * sqrt(0.6) AS weight FROM title_tfidf
      UNION ALL SELECT doc_id, 'abstract|' || term, weight FROM abstract_tfidf
      UNION ALL SELECT doc_id, 'terms|' || source, sqrt(0.5) FROM documents
      UNION ALL SELECT doc_id, 'authors|' || author, sqrt(0.5) / sqrt(n) FROM authors
      UNION ALL SELECT doc_id, 'pubtypes|' || lang, sqrt(0.4) FROM documents),
    signed AS (SELECT doc_id, string_agg(term || '=' || round(weight, 9)::VARCHAR, ',' ORDER BY term) AS sig
      FROM cells GROUP BY doc_id),
    reps AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS rep FROM signed),
    v AS (SELECT doc_id, term, round(weight, 9) AS weight FROM cells WHERE doc_id IN (SELECT rep FROM reps)),
    pairs AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.weight * b.weight) AS sim
      FROM v a JOIN v b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2)
    SELECT 'pair' AS kind, i, j, round(sim, 6) AS sim FROM pairs WHERE round(sim, 6) >= {COMBINED_MIN}
    UNION ALL SELECT 'copy', rep, doc_id, NULL FROM reps WHERE doc_id <> rep""",
)
def combined_similarity(spark, sf_dir):
    docs = texts(spark, sf_dir)
    # the people a document names are the mail addresses in it
    authors = docs.select("doc_id", F.array_distinct(F.regexp_extract_all("text", F.lit(MAIL), F.lit(0))).alias("mails"))
    titles = docs.select("doc_id", F.split("text", "\n")[0].alias("text"))
    parts = {
        "title": M.tfidf(M.token_rows(titles), titles),
        "abstract": M.tfidf(M.token_rows(docs), docs),
        "terms": docs.select("doc_id", F.col("source").alias("term"), F.lit(1.0).alias("weight")),
        "authors": authors.select(
            "doc_id", F.explode("mails").alias("term"), (1 / F.sqrt(F.size("mails"))).alias("weight")
        ),
        "pubtypes": docs.select("doc_id", F.col("lang").alias("term"), F.lit(1.0).alias("weight")),
    }
    return pairs_and_copies(*M.combined_similarity(parts, COMBINED_MIN))


@query(
    "minmax_per_term",
    f"""WITH {TFIDF}, b AS (SELECT term, max(weight) AS hi,
      CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN least(min(weight), 0) ELSE min(weight) END AS lo
      FROM tfidf GROUP BY term)
    SELECT doc_id, term, round((weight - lo) / (hi - lo), 6) AS weight FROM tfidf JOIN b USING (term)""",
)
def minmax_per_term(spark, sf_dir):
    docs, rows = document_rows(spark, sf_dir)
    scaled = M.minmax_per_term(M.tfidf(rows, docs), M.count_rows(docs))
    return scaled.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "attention_context_pairs",
    f"""WITH sent AS (
      SELECT doc_id, row_number() OVER () AS sid, sentence FROM (
        SELECT doc_id, unnest(regexp_split_to_array(text, '[.?!]')) AS sentence FROM documents)
      WHERE length(regexp_replace(sentence, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')) > 0),
    {S.filtered_rows('sent', key='sid', column='sentence')},
    sw AS (SELECT s.doc_id, s.sid, t.term FROM term_rows t JOIN sent s USING (sid)),
    n AS (SELECT count(*) AS n FROM sent),
    voc AS (SELECT term, count(*) AS c FROM sw GROUP BY term HAVING count(*) > 0.01 * (SELECT n FROM n)
      AND count(*) < 0.5 * (SELECT n FROM n)),
    {S.filtered_rows('benchmark', key='item_id').replace('toks', 'btoks').replace('bare_rows', 'bbare')
      .replace('term_rows', 'bterms').replace('tok ', 'btok ').replace('FROM tok', 'FROM btok')},
    att AS (SELECT DISTINCT term AS attention FROM bterms)
    SELECT a.attention, c.term AS context, c.doc_id, count(*) AS times
    FROM (SELECT DISTINCT sid, attention FROM sw JOIN att ON term = attention) a
    JOIN sw c ON c.sid = a.sid AND NOT contains(a.attention, c.term) JOIN voc ON voc.term = c.term GROUP BY 1, 2, 3""",
)
def attention_context_pairs(spark, sf_dir):
    docs = texts(spark, sf_dir, "doc_id", "text")
    bench = table(spark, sf_dir, "benchmark")
    listed = bench.select(F.explode(T.tokens_filtered(F.col("text"))).alias("phrase"))
    return E.attention_context_pairs(E.sentence_words(docs), listed)


@query(
    "vocab_stem_job",
)
def vocab_stem_job(spark, sf_dir):
    docs, rows = document_rows(spark, sf_dir)
    return ST.stem_terms(M.raw_counts(rows)).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
