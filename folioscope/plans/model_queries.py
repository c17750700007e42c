"""Topic models, embeddings, layouts, neighbours, hierarchies and hulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import embedding as E
from folioscope.operators import hierarchy as H
from folioscope.operators import hulls
from folioscope.operators import neighbors as NB
from folioscope.operators import topics as O
from folioscope.plans.graph_queries import quantity_edges
from folioscope.operators import graph as G
from folioscope.plans.registry import query, table, texts
from folioscope.plans.vector_queries import vectors


def documents(spark, sf_dir):
    return texts(spark, sf_dir, "doc_id", "text")


def parts(spark, sf_dir):
    """Title = first line, abstract = the other lines."""
    lines = F.split("text", "\n")
    return documents(spark, sf_dir).select(
        "doc_id",
        lines[0].alias("title"),
        F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n").alias("abstract"),
    )


def term_vectors(spark, sf_dir):
    # the texts are cut into words in every core, also where the table is a single row group
    docs = documents(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    return O.tfidf_vectors(docs.select("doc_id", T.tokens_filtered(F.col("text")).alias("words")))


@query("topics_lda")
def topics_lda(spark, sf_dir):
    weights, _ = O.topics_lda(term_vectors(spark, sf_dir))
    return weights.select("doc_id", F.posexplode("weights").alias("topic", "weight"))


@query("topic_top_words")
def topic_top_words(spark, sf_dir):
    _, words = O.topics_lda(term_vectors(spark, sf_dir))
    return O.topic_top_words(words)


@query("topic_of_doc")
def topic_of_doc(spark, sf_dir):
    weights, words = O.topics_lda(term_vectors(spark, sf_dir))
    return O.topic_of_doc(weights, O.topic_top_words(words))


@query("topics_nmf")
def topics_nmf(spark, sf_dir):
    weights, words = O.topics_nmf(term_vectors(spark, sf_dir))
    return O.topic_of_doc(weights, O.topic_top_words(words))


@query("svd_reduce")
def svd_reduce(spark, sf_dir):
    return O.svd_reduce(term_vectors(spark, sf_dir))


@query("doc_embedding")
def doc_embedding(spark, sf_dir):
    return E.doc_embedding(E.simple_words(documents(spark, sf_dir)))


@query("word_mean_embedding")
def word_mean_embedding(spark, sf_dir):
    return E.word_mean_embedding(E.simple_words(documents(spark, sf_dir)))


@query("doc_embedding_parts")
def doc_embedding_parts(spark, sf_dir):
    rows = parts(spark, sf_dir)
    found = [
        E.doc_embedding(rows.select("doc_id", T.tokens_filtered(F.col(c)).alias("words"))).select(
            F.lit(c).alias("part"), "doc_id", "vector"
        )
        for c in ("title", "abstract")
    ]
    return found[0].unionByName(found[1])


@query("doc_embedding_sentences")
def doc_embedding_sentences(spark, sf_dir):
    return E.doc_embedding_sentences(parts(spark, sf_dir), ["title", "abstract"])


@query("doc_embedding_attention")
def doc_embedding_attention(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    listed = bench.select(F.explode(T.tokens_filtered(F.col("text"))).alias("phrase"))
    pairs = E.attention_context_pairs(E.sentence_words(documents(spark, sf_dir)), listed)
    return E.doc_embedding_sentences(parts(spark, sf_dir), ["title", "abstract"], emphasis=pairs)


@query("layout_2d")
def layout_2d(spark, sf_dir):
    return E.layout_2d(vectors(spark, sf_dir))


@query("neighbor_affinity")
def neighbor_affinity(spark, sf_dir):
    """Customers and parts as points, closer the more is ordered."""
    edges = G.symmetric_edges(quantity_edges(spark, sf_dir))
    d = (F.lit(10.0) / F.col("weight")).alias("d")
    forward = edges.select(F.col("source").alias("i"), F.col("target").alias("j"), d)
    backward = edges.select(F.col("target").alias("i"), F.col("source").alias("j"), d)
    return NB.neighbor_affinity(forward.unionByName(backward), 20.0)


NEIGHBORS, PERPLEXITY = 15, 5.0


@query(
    "nearest_graph",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    reps AS (SELECT min(vec_id) AS id, v FROM v GROUP BY v),
    d AS (SELECT a.id AS i, b.id AS j, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)), 9) AS d
      FROM reps a JOIN reps b ON a.id <> b.id)
    SELECT i, j, round(d, 6) AS d FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= {NEIGHBORS}""",
)
def nearest_graph(spark, sf_dir):
    edges, _ = NB.nearest_graph(vectors(spark, sf_dir), NEIGHBORS)
    return edges.withColumn("d", F.round("d", 6))


@query("embedding_affinity")
def embedding_affinity(spark, sf_dir):
    """Kernel weights between the embeddings' nearest neighbours."""
    edges, _ = NB.nearest_graph(vectors(spark, sf_dir), NEIGHBORS)
    return NB.neighbor_affinity(edges, PERPLEXITY)


@query("hierarchical_clusters")
def hierarchical_clusters(spark, sf_dir):
    return H.hierarchical_clusters(vectors(spark, sf_dir), [20, 10, 5])[0]


@query("ward_merges")
def ward_merges(spark, sf_dir):
    return H.hierarchical_clusters(vectors(spark, sf_dir), [20, 10, 5])[1]


@query("convex_hull")
def convex_hull(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return hulls.convex_hull(orders, ["o_orderpriority"], "o_totalprice", "o_custkey")
