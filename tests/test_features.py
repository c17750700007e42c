from pyspark.sql import functions as F

from folioscope.operators import graph
from folioscope.plans import features
from folioscope.sources import writers

EDGES = [(1, 2), (3, 2), (1, 2), (2, 1), (9, 2), (1, 9)]
PARTS = "doc_id bigint, type string, year string, title string, abstract string, keywords array<string>, terms array<string>"


def test_citing_documents_are_listed_with_repeats(spark):
    edges = spark.createDataFrame(EDGES, "src bigint, dst bigint")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "doc_id bigint")
    found = {r.doc_id: r.citations for r in graph.citing_documents(edges, ids).collect()}
    assert found == {1: [2], 2: [1, 1, 3], 3: []}


def test_a_written_document_has_its_terms_and_citations(spark, monkeypatch):
    # topics have tests of their own
    def no_topics(vectors, key):
        weights = vectors.rows.select(key, F.array(F.lit(1.0)).alias("weights"))
        return weights, spark.createDataFrame([(0, "word", 1.0)], "topic int, term string, weight double")

    monkeypatch.setattr(features.topics, "topics_lda", no_topics)
    monkeypatch.setattr(features.topics, "topics_nmf", no_topics)
    said = {1: "green fox", 2: "green bear", 3: "bear", 4: "fox", 5: "owl", 6: "owl"}
    rows = [(i, "t", "", "red fox", text, ["k_w"], ["head_a", "head_b"] if i == 2 else []) for i, text in said.items()]
    docs = spark.createDataFrame(rows, PARTS).withColumns({"authors": F.array(F.lit("a")), "pubtypes": F.array(F.lit("p"))})
    edges = spark.createDataFrame(EDGES, "src bigint, dst bigint")
    relevant = spark.createDataFrame([(1,)], "doc_id bigint")
    vectors = spark.createDataFrame([(i, [float(i), 1.0 - i, 0.5 * i * i]) for i in said], "doc_id bigint, vector array<double>")
    written = writers.feature_rows(features.document_features(docs, edges, relevant, vectors))
    assert set(written.columns) == set(writers.FEATURE_FIELDS)
    found = {r.id: r for r in written.collect()}
    assert {i: r.citations for i, r in found.items()} == {"1": [2], "2": [1, 1, 3]} | {i: [] for i in "3456"}
    assert {i: r.number_of_citations for i, r in found.items()} == {"1": 1, "2": 3} | {i: 0 for i in "3456"}
    assert {i: r.terms for i, r in found.items()} == {"2": ["head_a", "head_b"]} | {i: [] for i in "13456"}
    # one document with subject headings is enough for these to be shown
    assert {i: r.keyword_display for i, r in found.items()} == {"2": "head a, head b"} | {i: "" for i in "13456"}
