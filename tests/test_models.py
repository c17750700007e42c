"""Similarity joins, clusters, ranking and models against brute force on small inputs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import vectors as V
from folioscope.operators import clusters as K
from folioscope.operators import embedding as E
from folioscope.operators import hierarchy as H
from folioscope.operators import neighbors as NB
from folioscope.operators import paragraphs as PV
from folioscope.operators import retrieval as O
from folioscope.operators import similarity
from folioscope.operators import terms as M
from folioscope.operators import topics as TP
from folioscope.operators import vectors as D


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    centres = rng.normal(scale=6, size=(4, 5))
    return np.concatenate([c + rng.normal(size=(20, 5)) for c in centres])


@pytest.fixture(scope="module")
def docs(spark, cloud):
    rows = [(i, [float(x) for x in v], i // 20) for i, v in enumerate(cloud)]
    return spark.createDataFrame(rows, "doc_id long, vector array<double>, label int").cache()


def test_cosine_pairs_with_a_hot_group_of_copies(spark):
    rng = np.random.default_rng(2)
    vectors = {i: {f"t{t}": 1.0 + int(rng.integers(3)) for t in rng.choice(12, 4, replace=False)} for i in range(40)}
    vectors |= {i: {"hot": 1.0, "t1": 1.0} for i in range(40, 60)}
    rows = []
    for i, v in vectors.items():
        size = math.sqrt(sum(w * w for w in v.values()))
        rows += [(i, t, w / size) for t, w in v.items()]
    pairs, members = M.cosine_pairs(spark.createDataFrame(rows, "doc_id long, term string, weight double"), 0.6)
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    assert len(rep) == 60 and {rep[i] for i in range(40, 60)} == {40}
    found = {(r["i"], r["j"]): r["sim"] for r in pairs.collect()}
    unit = {}
    for i, t, w in rows:
        unit.setdefault(i, {})[t] = w
    reps = sorted(set(rep.values()))
    expected = {}
    for i in reps:
        for j in reps:
            sim = sum(w * unit[j].get(t, 0) for t, w in unit[i].items())
            if i < j and round(sim, 6) >= 0.6:
                expected[i, j] = sim
    assert found.keys() == expected.keys() and expected
    assert all(found[p] == pytest.approx(expected[p], abs=1e-7) for p in found)


@pytest.mark.parametrize("listed, tile", [(None, None), (2, 200), (1000, None)])
@pytest.mark.parametrize("names", [int, str], ids=["numbers", "texts"])
def test_pairs_do_not_depend_on_the_way_they_take(spark, listed, tile, names):
    rng = np.random.default_rng(4)
    cells = {i: dict.fromkeys(rng.choice(30 if i % 2 else 400, rng.integers(1, 9), replace=False).tolist(), 0.0) for i in range(150)}
    for own in cells.values():
        own.update((t, float(rng.random() + 0.1)) for t in own)
        size = math.sqrt(sum(w * w for w in own.values()))
        own.update((t, round(w / size, 9)) for t, w in own.items())
    df = {}
    for own in cells.values():
        for t in own:
            df[t] = df.get(t, 0) + 1
    kind = {int: "long", str: "string"}[names]
    rows = [(names(i), [(t, w, df[t]) for t, w in sorted(own.items())]) for i, own in cells.items()]
    reps = spark.createDataFrame(rows, f"rep {kind}, vector array<struct<tid:long,weight:double,df:long>>")
    for bound in (0.3, 0.9):
        got = similarity.similar_pairs(reps, bound, 1.0, listed, tile).collect()
        want = {}
        for i in cells:
            for j in cells:
                if names(i) < names(j):
                    sim = sum(w * cells[j].get(t, 0.0) for t, w in cells[i].items())
                    if round(sim, 6) >= bound:
                        want[names(i), names(j)] = sim
        assert len(got) == len(want) and {(r["i"], r["j"]): pytest.approx(r["sim"]) for r in got} == want
    assert similarity.similar_pairs(reps.filter("false"), 0.5, 1.0).count() == 0


def test_tiles_are_read_by_their_pairs_and_not_copied(spark):
    rng = np.random.default_rng(9)
    rows = [(i, sorted(rng.choice(40, 6, replace=False).tolist()), rng.random(6).round(9).tolist()) for i in range(60)]
    own = spark.createDataFrame(rows, "rep long, tids array<bigint>, weights array<double>")
    found = similarity._crowded_pairs(own, 1.0, 40)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    want = {}
    for i, ti, wi in rows:
        for j, tj, wj in rows[i + 1 :]:
            sim = sum(w * dict(zip(tj, wj)).get(t, 0.0) for t, w in zip(ti, wi))
            if round(sim, 6) >= 1.0:
                want[i, j] = pytest.approx(sim)
    got = found.collect()
    assert len(got) == len(want) > 5 and {(r["i"], r["j"]): r["sim"] for r in got} == want


@pytest.mark.parametrize("dense, products", [(1, 7), (10**9, 1), (400, 10**6)])
def test_dots_of_pieces_do_not_depend_on_how_terms_are_multiplied(monkeypatch, dense, products):
    monkeypatch.setattr(similarity, "DENSE", dense)
    monkeypatch.setattr(similarity, "PRODUCTS", products)
    rng = np.random.default_rng(6)
    cells = [np.where(rng.random((n, 50)) < rng.random(50) / 2, rng.random((n, 50)), 0.0) for n in (30, 23)]
    cells[0][4] = 0.0
    tables = [(c.nonzero()[1], c[c.nonzero()], np.concatenate([[0], np.cumsum((c > 0).sum(1))])) for c in cells]
    pieces = [similarity._by_term((0, len(c)), t) for c, t in zip(cells, tables)]
    assert np.allclose(similarity._dots(*pieces, (30, 23)), cells[0] @ cells[1].T)


def test_copies_need_no_similarity_join(spark, monkeypatch):
    def no_join(*_):
        raise AssertionError("copies were joined by similarity")

    rows = [(1, "a", 0.6), (1, "b", 0.8), (2, "b", 0.8), (2, "a", 0.6), (3, "a", 1.0), (5, "a", 1.0), (4, "a", 0.6000001)]
    monkeypatch.setattr(M, "similar_pairs", no_join)
    members = M.vector_copies(spark.createDataFrame(rows, "doc_id long, term string, weight double"))
    assert {(r["doc_id"], r["rep"]) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (5, 3), (4, 4)}


def test_active_dims_and_scaling(spark):
    rows = spark.createDataFrame([(1, [0.0, 5.0, 1.0]), (2, [1.0, 0.0, 1.5])], "doc_id long, vector array<double>")
    assert [r["active"] for r in D.active_dims(rows, 2).orderBy("doc_id").collect()] == [[0.0, 5.0], [1.0, 0.0]]
    scaled = D.minmax_per_dim(rows).orderBy("doc_id").collect()
    assert [r["vector"] for r in scaled] == [[0.0, 1.0, 0.0], [1.0, 0.0, 1.0]]


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("sent", [8, 2])
def test_tables_of_several_tiles_give_the_same(spark, docs, cloud, monkeypatch, sent):
    monkeypatch.setattr(D, "SENT_TILES", sent)
    points = docs.withColumnRenamed("label", "cluster_id")
    fine = docs.select("doc_id", F.lit(0).alias("level"), (F.col("doc_id") % 16).alias("cluster_id"))
    levels = fine.union(docs.select("doc_id", F.lit(1), F.col("label").cast("long")))
    summary = K.cluster_summary(docs.selectExpr("doc_id", "vector", "0d as x", "0d as y"), levels)
    centres = docs.filter("doc_id % 7 = 0").select((F.col("doc_id") / 7).cast("int").alias("label"), "vector")
    for run in (
        lambda n: D.pairwise_distance(docs, V.euclidean, key="doc_id", tile_rows=n),
        lambda n: K.cluster_similarity(summary, tile_rows=n),
        lambda n: K.silhouette(docs, levels, tile_rows=n),
        lambda n: K.cluster_linkage(points, "average", tile_rows=n),
        lambda n: K.cluster_linkage(points, "single", tile_rows=n),
        lambda n: K.kmeans_assign(docs, centres, tile_rows=n).select("doc_id", "label"),
    ):
        whole = rows_of(run(None))
        assert whole and rows_of(run(7)) == whole
    assert D.pairwise_distance(docs, V.euclidean, key="doc_id", tile_rows=7).count() == 80 * 79 // 2


def test_kmeans_with_centres_as_a_table(docs, monkeypatch):
    held = rows_of(K.kmeans(docs, 4, iterations=3)[0])
    monkeypatch.setattr(K, "HELD_CENTRES", 3)
    monkeypatch.setattr(D, "TILE_ROWS", 2)
    labels, centres = K.kmeans(docs, 4, iterations=3)
    assert rows_of(labels) == held and sum(r["size"] for r in centres.collect()) == 80


def test_silhouette_of_a_single_member_is_zero(spark, docs):
    membership = docs.select("doc_id", F.lit(0).alias("level"), F.when(F.col("doc_id") == 0, 99).otherwise(F.col("label")).alias("cluster_id"))
    found = {r["doc_id"]: r["silhouette"] for r in K.silhouette(docs, membership).collect()}
    assert found[0] == 0 and len(found) == 80 and all(-1 <= s <= 1 for s in found.values())


def test_kmeans_follows_lloyd(docs, cloud):
    labels, centres = K.kmeans(docs, 4)
    found = {r["doc_id"]: r["label"] for r in labels.collect()}
    points, means = cloud, cloud[:4].copy()
    for _ in range(100):
        own = ((points[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        means = np.array([points[own == c].mean(axis=0) if (own == c).any() else means[c] for c in range(4)])
    assert [found[i] for i in range(80)] == list(own)
    assert sum(r["size"] for r in centres.collect()) == 80


def test_kmeans_1d_is_stable(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 50, 51, 52, 100, 101, 102])], "id long, v double")
    found = {r["value"]: r["label"] for r in K.kmeans_1d(rows, "v", [F.col("id")], 3).collect()}
    assert found[1.0] == found[3.0] and found[50.0] == found[52.0] and found[100.0] == found[102.0]
    assert len(set(found.values())) == 3


def test_ward_is_symmetric_and_levels_are_nested(docs):
    table = K.cluster_linkage(docs.withColumnRenamed("label", "cluster_id"), "ward")
    turned = K.cluster_linkage(docs.withColumn("cluster_id", -F.col("label")), "ward")
    back = {(-r["b"], -r["a"]): r["distance"] for r in turned.collect()}
    assert {(r["a"], r["b"]): pytest.approx(r["distance"]) for r in table.collect()} == back
    members, steps = H.hierarchical_clusters(docs, [8, 4, 2], micro=20)
    sizes = {r["level"]: r["n"] for r in members.groupBy("level").agg(F.count_distinct("cluster_id").alias("n")).collect()}
    assert sizes == {0: 8, 1: 4, 2: 2}
    pairs = members.groupBy("doc_id").pivot("level").agg(F.first("cluster_id")).select("0", "2").distinct()
    assert pairs.count() == 8 and steps.count() == 19
    four = members.filter("level = 1").join(docs, "doc_id").select("label", "cluster_id").distinct()
    assert four.count() == 4


def test_merges_in_rounds_equal_those_one_by_one(spark, docs, monkeypatch):
    whole = H.hierarchical_clusters(docs, [8, 4, 2], micro=20)
    monkeypatch.setattr(H, "HELD_MICRO", 5)
    monkeypatch.setattr(H, "TILE_ROWS", 6)
    rounds = H.hierarchical_clusters(docs, [8, 4, 2], micro=20)
    for one, other in zip(whole, rounds):
        assert one.columns == other.columns and one.dtypes == other.dtypes
    assert rows_of(whole[0]) == rows_of(rounds[0])
    plain, found = (sorted(r) for r in (rows_of(whole[1]), rows_of(rounds[1])))
    # the two sides of a merge have no order
    assert [(s, {a, b}, n) for s, a, b, _, n in plain] == [(s, {a, b}, n) for s, a, b, _, n in found]
    assert [d for *_, d, _ in plain] == pytest.approx([d for *_, d, _ in found])


def test_copies_merge_first(spark):
    rows = [(i, 1 + i % 3, [float(i // 4), 0.0]) for i in range(12)]
    merges = H.merge_rounds(spark.createDataFrame(rows, "id long, size long, vector array<double>"), 5)
    found = H.numbered_merges(merges, 12).orderBy("step").collect()
    assert len(found) == 11 and [r["distance"] for r in found[:9]] == [0.0] * 9 and found[-1]["size"] == sum(r[1] for r in rows)
    made = {i: {i} for i in range(12)}
    for r in found:
        made[12 + r["step"]] = made.pop(r["a"]) | made.pop(r["b"])
    assert made == {22: set(range(12))}
    assert H.merge_rounds(spark.createDataFrame(rows[:1], "id long, size long, vector array<double>")).count() == 0


def test_linkages_match_brute_force(docs, cloud):
    rows = docs.withColumnRenamed("label", "cluster_id")
    a, b = cloud[:20], cloud[20:40]
    gaps = np.linalg.norm(a[:, None] - b[None], axis=2)
    mean = np.linalg.norm(a.mean(axis=0) - b.mean(axis=0))
    expected = {"single": gaps.min(), "complete": gaps.max(), "average": gaps.mean(), "centroid": mean,
                "ward": mean * math.sqrt(2 * 20 * 20 / 40)}
    for method, value in expected.items():
        found = K.cluster_linkage(rows, method).filter("a = 0 AND b = 1").first()["distance"]
        assert found == pytest.approx(value)
    with pytest.raises(ValueError):
        K.cluster_linkage(rows, "median")


def test_recall_curve_and_work_saved(spark):
    ranking = spark.createDataFrame([(i, i, i + 1 in (2, 5, 9)) for i in range(10)], "doc_id long, rank long, relevant boolean")
    curve = O.precision_recall_curve(ranking, F.lit(3), block=3)
    found = [(r["precision"], r["recall"]) for r in curve.orderBy("rank").collect()]
    hits = np.cumsum([i + 1 in (2, 5, 9) for i in range(10)])
    assert found == [pytest.approx((h / (i + 1), h / 3)) for i, h in enumerate(hits)]
    assert O.wss95(curve).first()["wss"] == pytest.approx((10 - 8) / 11)


def one_by_one(points, relevant, order):
    order, hits = list(order), [i for i in order if relevant[i]]
    while len(order) < len(points):
        mean = points[hits].mean(axis=0) if hits else np.zeros(points.shape[1])
        size = np.linalg.norm(points, axis=1) * np.linalg.norm(mean)
        sims = np.where(size > 0, np.round(points @ mean / np.where(size > 0, size, 1), 10), -2)
        best = max((i for i in range(len(points)) if i not in order), key=lambda i: (sims[i], -i))
        order.append(best)
        hits += [best] if relevant[best] else []
    return order


@pytest.mark.parametrize("limits", [{}, {"MEANS": 3}, {"held": 2, "KEPT_OUT": 2}, {"held": 0, "MEANS": 4}])
@pytest.mark.parametrize("share, seed", [(3, [1, 3]), (3, [1]), (99, [0, 2]), (2, list(range(10)))])
def test_feedback_ranking_matches_the_one_by_one_process(spark, cloud, monkeypatch, limits, share, seed):
    for name in ("MEANS", "KEPT_OUT"):
        monkeypatch.setattr(O, name, limits.get(name, getattr(O, name)))
    points = np.concatenate([cloud[::6], cloud[:24:6], np.zeros((2, 5))])
    relevant = [i % share == 0 for i in range(len(points))]
    docs = spark.createDataFrame(
        [(i, [float(x) for x in v], r) for i, (v, r) in enumerate(zip(points, relevant))],
        "doc_id long, vector array<double>, relevant boolean",
    )
    first = spark.createDataFrame([(i, at) for at, i in enumerate(seed)], "doc_id long, rank long")
    rows = O.feedback_ranking(docs, first, held=limits.get("held", 100)).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == one_by_one(points, relevant, seed)
    assert [r["rank"] for r in rows] == list(range(len(points)))


def test_neighbor_affinity_reaches_the_perplexity(spark, cloud):
    points = cloud[::4]
    n = len(points)
    gaps = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    rows = [(i, j, float(gaps[i, j])) for i in range(n) for j in range(n) if i != j]
    found = NB.neighbor_affinity(spark.createDataFrame(rows, "i long, j long, d double"), 5.0).collect()
    assert sum(r["p"] for r in found) == pytest.approx(1.0)
    expected = np.zeros((n, n))
    for i in range(n):
        lo, hi = 0.0, 1e6
        for _ in range(200):
            beta = (lo + hi) / 2
            p = np.exp(-(gaps[i] - np.delete(gaps[i], i).min()) * beta)
            p[i] = 0
            p /= p.sum()
            entropy = -(p[p > 0] * np.log(p[p > 0])).sum()
            lo, hi = (beta, hi) if entropy > math.log(5.0) else (lo, beta)
        expected[i] = p
    joint = (expected + expected.T) / (2 * n)
    assert all(r["p"] == pytest.approx(joint[r["i"], r["j"]], abs=1e-5) for r in found)


def test_affinity_finds_a_bandwidth_at_any_scale(spark):
    rng = np.random.default_rng(3)
    rows, entropy = [], {}
    for i, scale in enumerate([1e-12, 1.0, 1e9, 1e15]):
        rows += [(i, 100 + j, float(scale * d)) for j, d in enumerate(np.sort(rng.random(30)) * [1] * 30)]
    rows += [(10, 100 + j, 0.0) for j in range(20)] + [(10, 130, 5.0)] + [(11, 100, 1.0), (11, 101, 3.0)]
    edges = spark.createDataFrame(rows, "i long, j long, d double")
    found = {(r["i"], r["j"]): r["p"] for r in NB.neighbor_affinity(edges, 5.0).collect()}
    for i in range(4):
        own = np.array([found[i, 100 + j] for j in range(30)])
        own = own / own.sum()
        entropy[i] = math.exp(-(own * np.log(own)).sum())
    assert all(entropy[i] == pytest.approx(5.0, abs=0.01) for i in range(4))
    # too many at the least distance: they share all; too few neighbours: all the same
    assert found[10, 130] == NB.FLOOR and found[10, 100] == pytest.approx(found[10, 119])
    assert found[11, 100] == pytest.approx(found[11, 101])


def test_affinity_of_few_and_of_many_neighbours_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, 100 + j, float(d)) for i in range(40) for j, d in enumerate(np.round(rng.random(int(rng.integers(2, 60))) * 10.0 ** rng.integers(-6, 6), 9))]
    edges = spark.createDataFrame(rows, "i long, j long, d double")
    by_rounds = {(r["i"], r["j"]): r["p"] for r in NB.neighbor_affinity(edges, 5.0, held=0).collect()}
    monkeypatch.setattr(NB, "SLICE_GAPS", 100)
    monkeypatch.setattr(NB, "_brackets", lambda *_: pytest.fail("points of few neighbours need no rounds"))
    at_once = {(r["i"], r["j"]): r["p"] for r in NB.neighbor_affinity(edges, 5.0).collect()}
    assert at_once.keys() == by_rounds.keys()
    assert all(p == pytest.approx(by_rounds[pair], rel=1e-5, abs=1e-12) for pair, p in at_once.items())


def test_kmeans_works_in_all_cores_on_a_table_of_one_part(spark):
    rng = np.random.default_rng(6)
    points = np.concatenate([c + rng.normal(size=(60, 4)) for c in rng.normal(scale=9, size=(5, 4))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    labels, centres = K.kmeans(spark.createDataFrame(rows, "doc_id long, vector array<double>").coalesce(1), 5)
    assert labels.select(F.spark_partition_id().alias("part")).distinct().count() > 1
    own = {r["doc_id"]: r["label"] for r in labels.collect()}
    for row in centres.collect():
        members = [points[i] for i, label in own.items() if label == row["label"]]
        assert len(members) == row["size"] and row["vector"] == pytest.approx(np.mean(members, axis=0))


def exact_nearest(points, k):
    gaps = np.round(((points[:, None] - points[None]) ** 2).sum(axis=2), 9)
    np.fill_diagonal(gaps, np.inf)
    return {(i, int(j)) for i in range(len(points)) for j in np.lexsort((np.arange(len(points)), gaps[i]))[:k]}


@pytest.mark.parametrize("limits", [{}, {"group_rows": 200, "leaf_rows": 60}, {"group_rows": 150, "leaf_rows": 150}])
def test_nearest_graph(spark, limits):
    rng = np.random.default_rng(8)
    centres = rng.normal(scale=4, size=(12, 16))
    points = np.concatenate([c + rng.normal(size=(50, 16)) for c in centres])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)] + [(1000 + i, [float(x) for x in points[7]]) for i in range(300)]
    docs = spark.createDataFrame([*rows, (5000, None)], "doc_id long, vector array<double>")
    edges, members = NB.nearest_graph(docs, 5, **limits)
    found = [(r["i"], r["j"]) for r in edges.collect()]
    assert len(found) == len(set(found)) == 600 * 5
    exact = exact_nearest(points, 5)
    assert len(exact & set(found)) / len(exact) >= (0.9 if limits else 1.0)
    pairs = spark.createDataFrame(list(exact), "i long, j long")
    assert NB.recall(edges, pairs) == pytest.approx(len(exact & set(found)) / len(exact))
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    assert len(rep) == 900 and all(rep[1000 + i] == 7 for i in range(300)) and rep[8] == 8
    assert NB.nearest_graph(docs.filter("false"), 5)[0].count() == 0


@pytest.fixture(scope="module")
def term_vectors(spark):
    topics = [["heart", "attack", "valve", "blood"], ["stock", "bond", "market", "price"], ["goal", "team", "match", "ball"]]
    rng = np.random.default_rng(0)
    rows = [(i, [str(w) for w in rng.choice(topics[i % 3], 12)]) for i in range(60)]
    return TP.tfidf_vectors(spark.createDataFrame(rows, "doc_id long, words array<string>"))


def separated(weights):
    lead = {}
    for r in weights.collect():
        lead.setdefault(r["doc_id"] % 3, set()).add(int(np.argmax(r["weights"])))
    return lead


def test_lda_and_nmf_find_the_topics(term_vectors):
    weights, words = TP.topics_lda(term_vectors, topics=3, passes=20)
    assert all(sum(r["weights"]) == pytest.approx(1.0) for r in weights.collect())
    assert TP.topic_top_words(words, 4).count() == 3
    weights, words = TP.topics_nmf(term_vectors, topics=3, rounds=60)
    lead = separated(weights)
    assert all(len(s) == 1 for s in lead.values()) and len(set.union(*lead.values())) == 3
    top = {frozenset(r["words"].split()) for r in TP.topic_top_words(words, 4).collect()}
    assert frozenset(["stock", "bond", "market", "price"]) in top
    assert TP.topic_of_doc(weights, TP.topic_top_words(words, 4)).count() == 60


def test_svd_matches_numpy(term_vectors):
    dense = np.array([r["features"].toArray() for r in term_vectors.rows.orderBy("doc_id").collect()])
    found = np.array([r["vector"] for r in TP.svd_reduce(term_vectors, size=5, passes=30).orderBy("doc_id").collect()])
    assert np.linalg.norm(found, axis=0) == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:5], abs=1e-6)


def test_svd_needs_no_basis_of_all_words_in_a_task(spark, term_vectors, monkeypatch):
    monkeypatch.setattr(TP, "MAX_CELLS", 10)
    monkeypatch.setattr(TP.R, "PART_DOCS", 4)
    dense = np.array([r["features"].toArray() for r in term_vectors.rows.orderBy("doc_id").collect()])
    found = np.array([r["vector"] for r in TP.svd_reduce(term_vectors, size=5, passes=20).orderBy("doc_id").collect()])
    assert np.linalg.norm(found, axis=0) == pytest.approx(np.linalg.svd(dense, compute_uv=False)[:5], abs=1e-6)


def test_svd_of_fewer_directions_than_asked_for(spark):
    rows = [(i, [["a", "b"], ["c", "d"]][i % 2]) for i in range(20)]
    vectors = TP.tfidf_vectors(spark.createDataFrame(rows, "doc_id long, words array<string>"), max_df=0.9)
    found = np.array([r["vector"] for r in TP.svd_reduce(vectors, size=3, passes=4).collect()])
    assert np.linalg.norm(found, axis=0) == pytest.approx([np.sqrt(10), np.sqrt(10), 0], abs=1e-6)


@pytest.mark.parametrize("docs", [1000, 7])
def test_nmf_equals_plain_updates_without_all_factors_on_the_driver(spark, term_vectors, monkeypatch, docs):
    monkeypatch.setattr(TP, "NMF_PART_DOCS", docs)
    dense = np.array([r["features"].toArray() for r in term_vectors.rows.orderBy("doc_id").collect()])
    n, width = dense.shape
    h = TP.R.seeded(np.arange(width), lambda rng, m: rng.uniform(0.1, 1.0, (m, 3)) / width, 1).T
    for turn in range(4):
        w = np.ones((n, 3))
        for _ in range(200):
            w *= (dense / np.maximum(w @ h, 1e-12)) @ h.T / (h.sum(axis=1) + 0.05 + 0.05 * w)
        if turn < 3:
            h = h * (w.T @ (dense / np.maximum(w @ h, 1e-12))) / (w.sum(axis=0)[:, None] + 0.05 + 0.05 * h)
    weights, words = TP.topics_nmf(term_vectors, topics=3, rounds=3, inner=200)
    found = np.array([r["weights"] for r in weights.orderBy("doc_id").collect()])
    place = {t: i for i, t in enumerate(term_vectors.words)}
    made = np.zeros_like(h)
    for r in words.collect():
        made[r["topic"], place[r["term"]]] = r["weight"]
    assert made == pytest.approx(h, rel=1e-3, abs=1e-6) and found == pytest.approx(w, rel=1e-2, abs=1e-3)


def test_topic_vectors_are_spread_over_tasks(spark):
    rows = spark.createDataFrame([(i, [f"w{i % 7}", f"w{i % 5}"]) for i in range(400)], "doc_id long, words array<string>")
    found = TP.tfidf_vectors(rows.coalesce(1), max_df=0.9).rows
    assert len(found.inputFiles()) >= spark.sparkContext.defaultParallelism


def test_embedding_and_layout(spark):
    rows = [(i, ["red", "blue", "green"] if i % 2 else ["cat", "dog", "cow"]) for i in range(40)]
    words = spark.createDataFrame(rows, "doc_id long, words array<string>")
    for found in (E.doc_embedding(words, dimensions=8, passes=2), E.word_mean_embedding(words, dimensions=8, passes=2)):
        assert found.count() == 40 and {len(r["vector"]) for r in found.collect()} == {8}
        assert E.layout_2d(found).columns == ["doc_id", "x", "y"]
    with pytest.raises(ValueError, match="raise min_count"):
        E.check_vocabulary(words, 1, limit=3)


def planted(seed, n, size, mixed=0.5, topics=6):
    """Documents of ``n`` words: some of their topic's, the others of words all share."""
    rng = np.random.default_rng(seed)
    own = [[f"t{t}w{i}" for i in range(40)] for t in range(topics)]
    shared = [f"s{i}" for i in range(200)]
    docs = [[str(w) for w in np.where(rng.random(size) < mixed, rng.choice(shared, size), rng.choice(own[d % topics], size))] for d in range(n)]
    return docs, np.arange(n) % topics


def share_of_same(vectors, labels, k=5):
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    return (labels[np.argsort(-sims, axis=1)[:, :k]] == labels[:, None]).mean()


def matrix(found):
    return np.array([r["vector"] for r in sorted(found.collect(), key=lambda r: r["doc_id"])])


@pytest.mark.parametrize("block_bytes", [64_000_000, 16_000])
def test_paragraph_vectors_find_planted_topics(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(PV, "BLOCK_BYTES", block_bytes)
    docs, labels = planted(1, 240, 60, mixed=0.6)
    words = spark.createDataFrame([(i, w) for i, w in enumerate(docs)], "doc_id long, words array<string>")
    bag = PV.bags(words, "doc_id")
    state = PV.begin(words, bag, "doc_id", dimensions=24, parts=4, seed=3)
    assert state.blocks == (1 if block_bytes > 10**6 else 3)
    found = share_of_same(matrix(PV.vectors(PV.train(state, bag), "doc_id")), labels)
    assert found > 0.95


def test_paragraph_vectors_are_repeatable_and_take_odd_documents(spark):
    docs, _ = planted(2, 30, 20)
    rows = [(i, w) for i, w in enumerate(docs)] + [(30, None), (31, []), (32, ["only once"]), (None, ["s1", "s2"]), (0, ["s1"])]
    words = spark.createDataFrame(rows, "doc_id long, words array<string>")
    found = [matrix(E.doc_embedding(words, dimensions=6, passes=3, parts=3)) for _ in range(2)]
    assert found[0].shape == (33, 6) and (found[0] == found[1]).all()
    assert (found[0][30:] == 0).all() and (found[0][:30] != 0).any(axis=1).all()
    assert E.doc_embedding(words.filter("false"), dimensions=6, passes=1).count() == 0


def test_a_part_tells_only_of_words_it_has_changed():
    rows = [(PV.DOC, 7, [], [], 0.0), (PV.CELL, 7, [0, 2], [3, 1], 0.0), *((PV.WORD, i, [], [], float(i < 2)) for i in range(50))]
    batch = pa.RecordBatch.from_pydict(
        {
            "part": pa.array([5] * len(rows), pa.int32()),
            "kind": pa.array([r[0] for r in rows], pa.int32()),
            "no": pa.array([r[1] for r in rows], pa.int64()),
            "vector": pa.array([b""] * len(rows), pa.binary()),
            "words": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
            "times": pa.array([r[3] for r in rows], pa.list_(pa.int32())),
            "noise": pa.array([r[4] for r in rows], pa.float64()),
        }
    )
    told = [r for b in PV._train_step(4, 1, [0.1, 0.1], 0)(iter([batch])) for r in b.to_pylist()]
    assert {r["no"] for r in told if r["kind"] == PV.DOC} == {7}
    # words 0 and 2 are held, word 1 is drawn as noise; no other can have changed
    assert {r["no"] for r in told if r["kind"] == PV.WORD} == {0, 1, 2}


def test_emphasis_moves_documents_of_a_phrase_together(spark):
    docs, labels = planted(5, 120, 40, mixed=0.9)
    words = spark.createDataFrame([(i, w) for i, w in enumerate(docs)], "doc_id long, words array<string>")
    marked = set(range(0, 120, 4))
    pairs = spark.createDataFrame([("s1", f"s{j}", i, 8) for i in marked for j in (2, 3, 4)], "attention string, context string, doc_id long, times long")
    plain = matrix(E.doc_embedding(words, dimensions=16, passes=10, parts=4))
    led = matrix(E.doc_embedding(words, dimensions=16, passes=10, parts=4, emphasis=pairs))

    own = sorted(marked)
    moved = led[own] - plain[own]
    unit = moved / np.linalg.norm(moved, axis=1, keepdims=True)
    assert (unit @ unit.T).mean() > 0.5
    still = [i for i in range(120) if i not in marked]
    assert (plain[still] == led[still]).all()


def test_prior_phrases_are_runs_of_content_words(spark):
    docs = spark.createDataFrame(
        [(1, "The heart attack, the heart of an Attack."), (2, None), (3, "nothing"), (4, "")], "doc_id long, text string"
    )
    listed = spark.createDataFrame([("heart attack",), ("Heart",), ("heart",), ("",), ("the",), (None,)], "phrase string")
    scores = {r["doc_id"]: r["score"] for r in O.prior_phrase_score(docs, listed).collect()}
    assert scores == {1: 4, 2: 0, 3: 0, 4: 0}
    none = O.prior_phrase_score(docs, listed.filter("phrase = 'the'"))
    assert {r["score"] for r in none.collect()} == {0}


def test_topic_limits_are_errors(spark):
    words = spark.createDataFrame([(i, [f"w{i % 3}", f"v{i % 4}"]) for i in range(20)], "doc_id long, words array<string>")
    with pytest.raises(ValueError, match="raise min_df"):
        TP.tfidf_vectors(words, most_words=3)
    vectors = TP.tfidf_vectors(words)
    for learn in (TP.topics_lda, TP.topics_nmf):
        with pytest.raises(ValueError, match="raise min_df"):
            learn(vectors, topics=TP.MAX_CELLS)


def test_more_levels_than_micro_clusters_is_an_error(spark, cloud):
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(cloud)], "doc_id long, vector array<double>")
    with pytest.raises(ValueError, match="raise micro"):
        H.hierarchical_clusters(docs, [10], micro=2)
