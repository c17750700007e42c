"""Citations, edge pruning, levels and communities."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import communities as C
from folioscope.operators import graph as G


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, sim double")


def count_frame(spark, n):
    return spark.range(n).agg(F.count(F.lit(1)).alias("n"))


def test_citations(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "B"), ("A", "X")], "src string, dst string")
    ids = spark.createDataFrame([("A",), ("B",)], "doc_id string")
    assert [tuple(r) for r in G.cited_by_reverse(edges, ids).collect()] == [("B", "A"), ("B", "A")]
    assert dict(G.citations_in_corpus(edges, ids).collect()) == {"A": 0, "B": 2}
    lists = G.citation_lists(G.cited_by_reverse(edges, ids), size=10).collect()
    assert [list(r["citations"]) for r in lists] == [["A", "A"]]


def test_long_citation_lists_are_split_and_whole(spark):
    reverse = spark.range(1000).select(F.lit("hot").alias("doc_id"), F.col("id").alias("cited_by"))
    lists = G.citation_lists(reverse, size=100).collect()
    assert len(lists) > 5
    assert sorted(x for r in lists for x in r["citations"]) == list(range(1000))


def test_fraction_keeps_ties(spark):
    # 12 documents: k = 1; the two best of document 0 are equal, so both stay
    edges = [(0, d, s) for d, s in zip(range(1, 12), [0.9, 0.9, 0.8] + [0.1] * 8)]
    kept = G.top_edges_fraction(edge_frame(spark, edges + [(0, 0, 1.0)]), count_frame(spark, 12))
    assert sorted(r["dst"] for r in kept.collect()) == [1, 2]


def test_small_corpus_keeps_every_edge(spark):
    edges = [(0, d, d / 10) for d in range(1, 8)]
    assert G.top_edges_fraction(edge_frame(spark, edges), count_frame(spark, 8)).count() == 7


def test_kth_value_by_counting_matches_sorting(spark):
    rng = random.Random(3)
    edges = [(s, d, round(rng.random() ** 3, 3)) for s in range(5) for d in range(10, 10 + 40 * (s + 1))]
    kept = {(r["src"], r["dst"]) for r in G.top_edges_sqrt_degree(edge_frame(spark, edges)).collect()}
    expected = set()
    for s in range(5):
        own = sorted((e for e in edges if e[0] == s and e[2] > 0), key=lambda e: -e[2])
        cut = own[int(len(own) ** 0.5)][2]
        expected |= {(e[0], e[1]) for e in own if e[2] >= cut}
    assert kept == expected


def test_symmetric_edges_prefer_forward(spark):
    edges = edge_frame(spark, [(1, 2, 0.4), (2, 1, 0.9), (4, 3, 0.7), (5, 5, 1.0)])
    assert {tuple(r) for r in G.symmetric_edges(edges).collect()} == {(1, 2, 0.4), (3, 4, 0.7)}


def two_cliques(spark):
    pairs = list(itertools.combinations(range(6), 2)) + list(itertools.combinations(range(6, 12), 2)) + [(0, 6)]
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source long, target long, weight double")


def test_communities_find_two_cliques(spark):
    edges = two_cliques(spark)
    levels = C.community_levels(edges)
    scores = [r["modularity"] for r in G.modularity(edges, levels, ["level"]).orderBy("level").collect()]
    assert len(scores) == 3 and scores == sorted(scores)
    top = levels.filter("level = 2").collect()
    groups = {}
    for r in top:
        groups.setdefault(r["cluster_id"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(6)), list(range(6, 12))]


def test_three_levels(spark):
    frames = [spark.createDataFrame([(1, c)], "node long, cluster_id long") for c in range(5)]
    pick = lambda n: [r["cluster_id"] for r in C.three_levels(frames[:n]).orderBy("level").collect()]
    assert pick(1) == [0, 0, 0] and pick(2) == [0, 0, 1] and pick(5) == [2, 3, 4]
    with pytest.raises(ValueError):
        C.three_levels([])


@pytest.mark.parametrize("at_once", [0, 12])
def test_no_node_gains_by_leaving_its_community(spark, at_once):
    rng = random.Random(9)
    weights = {}
    for a, b in itertools.combinations(range(40), 2):
        if rng.random() < (0.5 if a % 4 == b % 4 else 0.06):
            weights[a, b] = float(rng.randrange(1, 5))
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "source long, target long, weight double")
    levels = C.community_levels(edges, at_once)
    cluster = {r["node"]: r["cluster_id"] for r in levels.filter("level = 0").collect()}
    total, degree = sum(weights.values()), dict.fromkeys(range(40), 0.0)
    for (a, b), w in weights.items():
        degree[a] += w
        degree[b] += w

    def modularity(of):
        inner = sum(w for (a, b), w in weights.items() if of[a] == of[b])
        sums = {}
        for node, own in of.items():
            sums[own] = sums.get(own, 0.0) + degree[node]
        return inner / total - sum((s / 2 / total) ** 2 for s in sums.values())

    last = {r["node"]: r["cluster_id"] for r in levels.filter("level = 2").collect()}
    assert modularity(last) >= modularity(cluster) > 0.2
    if levels.select("level", "cluster_id").distinct().groupBy("level").count().select("count").distinct().count() == 1:
        cluster = last
    best = modularity(cluster)
    assert all(modularity({**cluster, node: other}) <= best + 1e-9 for node in cluster for other in set(cluster.values()))


def test_communities_settle_in_few_rounds(spark, monkeypatch):
    # all nodes of a clique want to go to the same cluster: one move for each cluster and round would take as many rounds as nodes
    cliques = [range(0, 30), range(30, 60)]
    edges = [(a, b, 1.0) for nodes in cliques for a, b in itertools.combinations(nodes, 2)]
    written, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda df: written.append(1) or cut(df))
    frame = spark.createDataFrame(edges, "source long, target long, weight double")
    levels = C.community_levels(frame, 0).filter("level = 2").collect()
    groups = {}
    for r in levels:
        groups.setdefault(r["cluster_id"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(nodes) for nodes in cliques]
    assert len(written) < 60


def test_modularity_does_not_repeat_edges_for_each_level(spark):
    weights = {(0, 1): 2.0, (1, 2): 1.0, (2, 3): 4.0, (0, 3): 1.0}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "source long, target long, weight double")
    rows = [(node, level, cluster) for node in range(4) for level, cluster in enumerate(["ab"[node // 2], "all", None])]
    found = G.modularity(edges, spark.createDataFrame(rows, "node long, level int, cluster_id string"), ["level"])
    scores = {r["level"]: (r["modularity"], r["n_clusters"]) for r in found.collect()}
    assert scores[0] == (pytest.approx(6 / 8 - (6 / 16) ** 2 - (10 / 16) ** 2), 2) and scores[1] == (pytest.approx(0.0), 1)
    assert scores[2] == (pytest.approx(-1.0), 1)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert not any("level" in line for line in joins)
