"""The written document features, assembled from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions import vectors as V
from folioscope.operators import clusters, embedding, graph, phrases, retrieval, topics
from folioscope.operators.ordering import global_rank
from folioscope.operators.terms import conditional_display
from folioscope.operators.vectors import active_dims, minmax_per_dim


def document_features(
    docs: DataFrame, edges: DataFrame, relevant: DataFrame, vectors: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """One row per document with every written field.

    ``docs``: key, type, year, title, abstract, and the arrays keywords, terms (subject headings), authors and pubtypes.
    ``edges``: citations (src, dst). ``vectors``: key, vector. All joins are on the document key. The display shows the
    subject headings if any document has one, else the keywords; ``citations`` are the citing documents of the corpus.
    """
    texts = conditional_display(docs).select(
        key,
        "type",
        "year",
        F.array_join(T.tokens_filtered(F.col("title")), " ").alias("title_all"),
        T.clean_raw_text(F.col("title")).alias("title_raw"),
        F.array_join(T.tokens_filtered(F.col("abstract")), " ").alias("abstract_all"),
        T.clean_raw_text(F.col("abstract")).alias("abstract_raw"),
        "keyword_display",
        "keywords",
        "terms",
        "authors",
        "pubtypes",
    )
    numbered = global_rank(docs.select(key), [F.col(key)], "index", start=0)
    joined = F.concat(F.col("title_raw"), F.lit(" "), F.col("abstract_raw")).alias("text")
    top = phrases.document_top_phrases(texts.select(key, joined), 30, key, max_words=3)
    named = phrases.phrase_lists(top, [key]).select(key, F.array_join("phrases", ", ").alias("keyword_rake"))
    words = texts.select(key, F.split("abstract_all", " ").alias("words"))
    features = topics.tfidf_vectors(words, key)
    lda = _topic_field(*topics.topics_lda(features, key), "topic_lda", key)
    nmf = _topic_field(*topics.topics_nmf(features, key), "topic_nmf", key)
    ids = docs.select(key)
    inside = graph.refs_in_corpus(edges, ids, key)
    references = inside.groupBy(F.col("src").alias(key)).agg(F.sort_array(F.collect_list("dst")).alias("references"))
    citing = graph.citing_documents(edges, ids, key).withColumn("number_of_citations", F.size("citations").cast("long"))
    places = embedding.layout_2d(vectors, key).select(
        key, F.col("x").alias("layout_tsne_text_x"), F.col("y").alias("layout_tsne_text_y")
    )
    forms = minmax_per_dim(active_dims(vectors, vector="vector", out="vector_PV_active"), out="vector_PV_normDim")
    forms = forms.select(
        key, F.col("vector").alias("vector_PV"), "vector_PV_active",
        V.minmax_within(F.col("vector")).alias("vector_PV_normArticle"), "vector_PV_normDim",
    )
    rows = retrieval.highlight_flag(texts, relevant, key)
    for part in (numbered, named, lda, nmf, references, citing, places, forms):
        rows = rows.join(part, key, "left")
    return rows.withColumn("id", F.col(key).cast("string"))


def _topic_field(weights: DataFrame, words: DataFrame, name: str, key: str) -> DataFrame:
    return topics.topic_of_doc(weights, topics.topic_top_words(words), key).select(key, F.col("words").alias(name))


def cluster_entities(
    docs: DataFrame, membership: DataFrame, relevant: DataFrame, layout: DataFrame, key: str = "doc_id"
) -> dict[str, DataFrame]:
    """The written cluster tables: sizes, maps, key phrases, summaries with silhouettes, similarity."""
    top_level = 2
    silhouettes = clusters.silhouette(layout, membership, key)
    summary = clusters.cluster_summary(layout, membership, key=key)
    mean_silhouette = silhouettes.groupBy("level", "cluster_id").agg(F.avg("silhouette").alias("silhouette"))
    counts, members = clusters.cluster_highlights(membership, relevant, key)
    by = ["level", "cluster_id"]
    return {
        "levels": summary.groupBy("level").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("size").alias("n_docs")),
        "maps": graph.level_map(membership, key),
        "sub_ids": graph.cluster_sub_id(membership, top_level, key),
        "keywords": phrases.phrase_lists(phrases.cluster_keywords(docs, membership), by),
        "summaries": summary.join(mean_silhouette, by).join(counts, by),
        "highlights": members,
        "similarity": clusters.cluster_similarity(summary),
    }
