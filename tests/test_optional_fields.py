from folioscope.sources import writers


def test_a_hot_document_stays_one_row(spark, tmp_path):
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id bigint")
    clusters = spark.createDataFrame([(i, [i, i + 1]) for i in range(5)], "doc_id bigint, clusters array<bigint>")
    edges = spark.createDataFrame([(0, t, 1.0) for t in range(1, 200)] + [(1, 0, 2.0)], "source bigint, target bigint, weight double")
    path = str(tmp_path / "optional")
    writers.write_optional_fields(docs, [clusters], edges, path, size=10)
    rows, lists = writers.read_optional_fields(docs, [clusters], edges, path)
    assert sorted((r.doc_id, r.clusters) for r in rows.collect()) == [(i, [i, i + 1]) for i in range(5)]
    found = lists.collect()
    assert sum(r.doc_id == 0 for r in found) > 1
    assert sorted((r.doc_id, t, w) for r in found for t, w in zip(r.edges, r.weights)) == sorted(map(tuple, edges.collect()))


def test_the_query_gives_each_document_once(spark):
    from folioscope.plans.registry import registered

    rows = registered()["write_optional_doc_fields"].run(spark, "/root/testdata/sf0.001")
    assert {"clusters", "n_edges"} <= set(rows.columns) and "edges" not in rows.columns
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert ids and len(set(ids)) == len(ids)
