"""Ranking by prior phrases, feedback, precision, recall and work saved."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import retrieval as O
from folioscope.plans import sqltext as S
from folioscope.plans.registry import query, table, texts
from folioscope.plans.vector_queries import vectors

# Prior phrases: the distinct content words of the benchmark texts.
PRIOR = f"""{S.filtered_rows('documents').replace('term_rows', 'doc_terms').replace('bare_rows', 'doc_bare')
  .replace('toks', 'doc_toks').replace('tok ', 'doc_tok ').replace('FROM tok', 'FROM doc_tok')},
{S.filtered_rows('benchmark', key='item_id')},
prior AS (SELECT DISTINCT term AS phrase FROM term_rows)"""
RANKED = f"""{PRIOR},
hits AS (SELECT doc_id, phrase, count(*) AS n FROM doc_terms JOIN prior ON term = phrase GROUP BY 1, 2),
scores AS (SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS score
  FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id),
ranking AS (
  SELECT s.doc_id, score, row_number() OVER (ORDER BY score DESC, s.doc_id) - 1 AS rank,
    l.doc_id IS NOT NULL AS relevant
  FROM scores s LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON s.doc_id = l.doc_id)"""


def prior_phrases(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    return bench.select(F.explode(T.tokens_filtered(F.col("text"))).alias("phrase")).distinct()


def relevant(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")


def ranking(spark, sf_dir):
    ranked = O.prior_phrase_rank(texts(spark, sf_dir, "doc_id", "text"), prior_phrases(spark, sf_dir))
    return O.mark_relevant(ranked, relevant(spark, sf_dir))


@query("prior_phrase_rank", f"WITH {RANKED} SELECT doc_id, score, rank FROM ranking")
def prior_phrase_rank(spark, sf_dir):
    return O.prior_phrase_rank(texts(spark, sf_dir, "doc_id", "text"), prior_phrases(spark, sf_dir))


@query(
    "seed_until_relevant",
    f"""WITH {RANKED} SELECT doc_id, rank, relevant FROM ranking
    WHERE rank <= (SELECT min(rank) FROM ranking WHERE relevant)""",
)
def seed_until_relevant(spark, sf_dir):
    return O.seed_until_relevant(ranking(spark, sf_dir)).select("doc_id", "rank", "relevant")


CURVE = f"""{RANKED},
curve AS (
  SELECT doc_id, rank,
    sum(relevant::INT) OVER (ORDER BY rank) / (rank + 1.0) AS precision,
    sum(relevant::INT) OVER (ORDER BY rank) / (SELECT count(*)::DOUBLE FROM labels WHERE toxic = 1) AS recall
  FROM ranking)"""


def curve(spark, sf_dir):
    listed = relevant(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).scalar()
    return O.precision_recall_curve(ranking(spark, sf_dir), listed)


@query(
    "precision_recall_curve",
    f"""WITH {CURVE} SELECT doc_id, rank, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve""",
)
def precision_recall_curve(spark, sf_dir):
    return curve(spark, sf_dir).select(
        "doc_id", "rank", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")
    )


@query(
    "wss95",
    f"""WITH {CURVE} SELECT round(((SELECT count(*) FROM curve) - min(rank)) / ((SELECT count(*) FROM curve) + 1.0), 6)
      AS wss FROM curve WHERE recall >= 0.95""",
)
def wss95(spark, sf_dir):
    return O.wss95(curve(spark, sf_dir)).select(F.round("wss", 6).alias("wss"))


@query(
    "highlight_flag",
    """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN '1' ELSE '0' END
      AS if_highlight FROM documents""",
)
def highlight_flag(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return O.highlight_flag(table(spark, sf_dir, "documents").select("doc_id"), ids)


# One document a step, over all rows: the state has every document, its vector, whether and when it was picked, and the
# sum of the relevant vectors found so far.
FEEDBACK = """WITH RECURSIVE marked AS (
  SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, EXISTS (SELECT 1 FROM labels WHERE toxic = 1 AND doc_id = vec_id) AS relevant
  FROM embeddings),
ordered AS (SELECT *, row_number() OVER (ORDER BY v[1] DESC, doc_id) - 1 AS place FROM marked),
seeded AS (SELECT *, place <= coalesce((SELECT min(place) FROM ordered WHERE relevant), place) AS first FROM ordered),
begun AS (SELECT list(x ORDER BY dim) AS total FROM (
  SELECT dim, sum(x) AS x FROM (
    SELECT unnest(v) AS x, unnest(range(len(v))) AS dim FROM seeded WHERE first AND relevant) GROUP BY dim)),
steps AS (
  SELECT doc_id, v, relevant, CASE WHEN first THEN place END AS rank, CASE WHEN first THEN 0 END AS round,
    (SELECT total FROM begun) AS total, 1 AS turn, (SELECT count(*) FROM seeded WHERE first) AS taken
  FROM seeded
  UNION ALL
  SELECT doc_id, v, relevant, CASE WHEN place = 1 AND rank IS NULL THEN taken ELSE rank END,
    CASE WHEN place = 1 AND rank IS NULL THEN turn ELSE round END,
    CASE WHEN hit THEN list_transform(list_zip(total, best), lambda z: z[1] + z[2]) ELSE total END,
    turn + hit::INT, taken + 1
  FROM (
    SELECT *, first_value(relevant) OVER (ORDER BY place) AS hit, first_value(v) OVER (ORDER BY place) AS best FROM (
      SELECT *, row_number() OVER (ORDER BY rank IS NOT NULL, round(list_cosine_similarity(v, total), 12) DESC, doc_id) AS place
      FROM steps WHERE taken < (SELECT count(*) FROM marked))))
SELECT doc_id, rank, round, relevant FROM steps WHERE taken = (SELECT count(*) FROM marked)"""


@query("feedback_ranking", FEEDBACK)
def feedback_ranking(spark, sf_dir):
    docs = O.mark_relevant(vectors(spark, sf_dir).select("doc_id", "vector"), relevant(spark, sf_dir))
    # the seed: documents in the order of their first component, up to the first relevant one
    order = O.global_rank(docs.select("doc_id", "relevant", F.col("vector")[0].alias("x")),
                          [F.col("x").desc(), F.col("doc_id")], start=0)
    return O.feedback_ranking(docs, O.seed_until_relevant(order)).drop("sim")
