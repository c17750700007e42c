"""Text cleaning, tokens, phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import phrases as P
from folioscope.plans import sqltext as S
from folioscope.plans.registry import dealt_texts, query, table, texts


def clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.clean_raw_text(F.col("text")).alias("text"))


CLEAN = f"clean AS (SELECT doc_id, {S.clean_of('text')} AS text FROM documents)"


@query(
    "top_phrases",
    f"""WITH {CLEAN}, {S.phrase_rows('clean', max_words=3)}, {S.score_rows('doc_id')}
    SELECT * FROM (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS rank, phrase, score
      FROM scored) WHERE rank <= 30""",
)
def top_phrases(spark, sf_dir):
    return P.document_top_phrases(clean_documents(spark, sf_dir), 30, max_words=3)


@query(
    "phrase_score",
    f"""WITH {CLEAN}, {S.phrase_rows('clean')}, {S.score_rows('doc_id')} SELECT * FROM scored""",
)
def phrase_score(spark, sf_dir):
    return P.document_phrase_score(clean_documents(spark, sf_dir))


@query(
    "candidate_phrases",
    f"""WITH {CLEAN}, {S.phrase_rows('clean')}
    SELECT doc_id, phrase, count(*) AS times FROM phr GROUP BY doc_id, phrase""",
)
def candidate_phrases(spark, sf_dir):
    rows = P.candidate_phrases(dealt_documents(spark, sf_dir))
    return rows.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("times"))


def documents(spark, sf_dir):
    return texts(spark, sf_dir, "doc_id", "text")


def clean_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.clean_raw_text(F.col("text")).alias("text"))


def dealt_documents(spark, sf_dir):
    return dealt_texts(spark, sf_dir).select("doc_id", T.clean_raw_text(F.col("text")).alias("text"))


@query("strip_non_ascii", f"SELECT doc_id, {S.ascii_of('text')} AS stripped FROM documents")
def strip_non_ascii(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.strip_non_ascii(F.col("text")).alias("stripped"))


@query("clean_raw_text", f"SELECT doc_id, {S.clean_of('text')} AS cleaned FROM documents")
def clean_raw_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.clean_raw_text(F.col("text")).alias("cleaned"))


@query(
    "tokens_filtered",
    f"""WITH {S.filtered_rows('documents')}
    SELECT d.doc_id, coalesce(string_agg(t.term, ' ' ORDER BY t.pos), '') AS words, count(t.term) AS n_words
    FROM documents d LEFT JOIN term_rows t USING (doc_id) GROUP BY d.doc_id""",
)
def tokens_filtered(spark, sf_dir):
    words = T.tokens_filtered(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", words.alias("w")).select(
        "doc_id", F.array_join("w", " ").alias("words"), F.size("w").cast("bigint").alias("n_words")
    )


@query(
    "tokens_simple",
    f"""WITH {S.token_rows('documents')},
    simple AS (SELECT doc_id, pos, CASE WHEN w IN ('.', '?', '!') THEN '.' ELSE {S.bare('w')} END AS w FROM tok),
    kept AS (SELECT * FROM simple WHERE length(w) BETWEEN 1 AND 40
             AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ('aeds', 'aed'))
    SELECT d.doc_id, replace(coalesce(string_agg(k.w, ' ' ORDER BY k.pos), ''), ' .', '.') AS simple
    FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id""",
)
def tokens_simple(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.tokens_simple(F.col("text")).alias("simple"))


@query(
    "sentence_split",
    """WITH parts AS (
      SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(text, '[.?!]')),
             '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS sentence FROM documents)
    SELECT doc_id, sentence, count(*) AS times FROM parts WHERE length(sentence) > 0 GROUP BY doc_id, sentence""",
)
def sentence_split(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    return rows.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("times"))


TOKEN_TESTS = f"""WITH {S.token_rows('documents')}
    SELECT doc_id, count(*) AS n_tokens,
      count(*) FILTER ({{}}) AS hits FROM tok GROUP BY doc_id"""


def token_test(spark, sf_dir, test):
    found = documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return found.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.filter("t", test)).cast("bigint").alias("hits")
    )


@query("is_numeric", TOKEN_TESTS.format("regexp_matches(w, '^[0-9]+$')"))
def is_numeric(spark, sf_dir):
    return token_test(spark, sf_dir, T.is_numeric)


@query("contains_digit", TOKEN_TESTS.format("regexp_matches(w, '[0-9]')"))
def contains_digit(spark, sf_dir):
    return token_test(spark, sf_dir, T.contains_digit)


@query("is_punct", TOKEN_TESTS.format("length(w) = 1 AND contains('!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', w)"))
def is_punct(spark, sf_dir):
    return token_test(spark, sf_dir, T.is_punct)


@query(
    "substring_count",
    """SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n_the,
      CAST((length(text) - length(replace(text, 'anan', ''))) / 4 AS BIGINT) AS n_anan FROM documents""",
)
def substring_count(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        T.substring_count(F.col("text"), F.lit("the")).alias("n_the"),
        T.substring_count(F.col("text"), F.lit("anan")).alias("n_anan"),
    )


@query(
    "year_digits",
    """SELECT page_id, regexp_replace(url, '[^0-9]', '', 'g') AS url_digits FROM pages""",
)
def year_digits(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.digits_of(F.col("url")).alias("url_digits"))


@query(
    "html_escape",
    """SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
      '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;') AS escaped FROM pages""",
)
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query(
    "phrase_dedupe",
    f"""WITH {CLEAN}, {S.phrase_rows('clean', max_words=3)},
    occ AS (SELECT doc_id, phrase, run, count(*) OVER (PARTITION BY doc_id, phrase) AS c FROM phr),
    lead_phr AS (SELECT doc_id, run, phrase, lead(phrase) OVER (PARTITION BY doc_id ORDER BY run) AS nxt FROM phr),
    long AS (SELECT doc_id, phrase || ' ' || nxt AS phrase FROM lead_phr WHERE nxt IS NOT NULL)
    SELECT doc_id, phrase, count(*) AS times FROM (
      SELECT doc_id, phrase FROM phr
      UNION ALL
      SELECT l.doc_id, l.phrase FROM long l
      WHERE NOT EXISTS (SELECT 1 FROM phr p WHERE p.doc_id = l.doc_id AND p.phrase = l.phrase))
    GROUP BY doc_id, phrase""",
)
def phrase_dedupe(spark, sf_dir):
    short = dealt_documents(spark, sf_dir).select("doc_id", P.phrase_array(F.col("text"), 3).alias("short"))
    joined = F.when(
        F.size("short") > 1,
        F.transform(
            F.arrays_zip(
                F.slice("short", 1, F.size("short") - 1).alias("a"), F.slice("short", 2, F.size("short") - 1).alias("b")
            ),
            lambda p: F.concat_ws(" ", p["a"], p["b"]),
        ),
    ).otherwise(F.array().cast("array<string>"))
    merged = short.withColumn("long", joined).select(
        "doc_id", F.explode(P.phrase_dedupe("short", "long")).alias("phrase")
    )
    return merged.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("times"))
