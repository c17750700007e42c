"""Citations, edge pruning, levels and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import communities as C
from folioscope.operators import graph as G
from folioscope.plans.registry import query, table
from folioscope.session import cut_lineage

# Citations: an order cites the parts it lists; the documents table is the corpus, so some resolve.


def citing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return edges, table(spark, sf_dir, "documents").select("doc_id")


@query(
    "refs_in_corpus",
    """SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS times FROM lineitem
    WHERE l_partkey IN (SELECT doc_id FROM documents) GROUP BY 1, 2""",
)
def refs_in_corpus(spark, sf_dir):
    edges, ids = citing(spark, sf_dir)
    return G.refs_in_corpus(edges, ids).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))


@query(
    "cited_by_reverse",
    """SELECT l_partkey AS doc_id, l_orderkey AS cited_by FROM lineitem JOIN documents ON l_partkey = doc_id""",
)
def cited_by_reverse(spark, sf_dir):
    return G.cited_by_reverse(*citing(spark, sf_dir))


@query(
    "citation_lists",
    """SELECT l_partkey AS doc_id, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS citations, 0 AS chunk
    FROM lineitem JOIN documents ON l_partkey = doc_id GROUP BY l_partkey""",
)
def citation_lists(spark, sf_dir):
    lists = G.citation_lists(G.cited_by_reverse(*citing(spark, sf_dir)))
    joined = F.array_join(F.transform("citations", lambda c: c.cast("string")), ",")
    return lists.select("doc_id", "chunk", joined.alias("citations"))


@query(
    "citations_in_corpus",
    """WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem
      WHERE l_partkey IN (SELECT doc_id FROM documents) AND l_orderkey IN (SELECT doc_id FROM documents))
    SELECT doc_id, count(src) AS n_citations FROM documents LEFT JOIN e ON dst = doc_id GROUP BY doc_id""",
)
def citations_in_corpus(spark, sf_dir):
    return G.citations_in_corpus(*citing(spark, sf_dir))


# Similarity edges: customers and parts, weighted by the quantity ordered; both id ranges start at 0,
# so some pairs occur in both directions.
EDGES = """edges AS (
  SELECT o_custkey AS src, l_partkey AS dst, sum(l_quantity) AS sim
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_partkey GROUP BY 1, 2)"""
FRACTION = f"""{EDGES},
top_fraction AS (
  SELECT src, dst, sim FROM (SELECT *, rank() OVER (PARTITION BY src ORDER BY sim DESC) AS r FROM edges)
  WHERE r <= (SELECT floor(0.01 * (count(*) - 1)) FROM customer))"""


def quantity_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return (
        joined.filter(F.col("o_custkey") != F.col("l_partkey"))
        .groupBy(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))
        .agg(F.sum("l_quantity").alias("sim"))
    )


def pruned_edges(spark, sf_dir):
    n_docs = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    return G.top_edges_fraction(quantity_edges(spark, sf_dir), n_docs, 0.01)


@query("top_edges_fraction", f"WITH {FRACTION} SELECT src, dst, sim FROM top_fraction")
def top_edges_fraction(spark, sf_dir):
    return pruned_edges(spark, sf_dir).select("src", "dst", "sim")


@query("graph_degree", f"WITH {FRACTION} SELECT src, count(*) AS degree FROM top_fraction GROUP BY src")
def graph_degree(spark, sf_dir):
    return G.graph_degree(pruned_edges(spark, sf_dir))


@query(
    "top_edges_sqrt_degree",
    f"""WITH {FRACTION}, d AS (SELECT *, count(*) OVER (PARTITION BY src) AS degree,
      rank() OVER (PARTITION BY src ORDER BY sim DESC) AS r FROM top_fraction)
    SELECT src, dst, sim FROM d WHERE r <= floor(sqrt(degree)) + 1""",
)
def top_edges_sqrt_degree(spark, sf_dir):
    return G.top_edges_sqrt_degree(pruned_edges(spark, sf_dir)).select("src", "dst", "sim")


SYMMETRIC = f"""{EDGES},
sym AS (
  SELECT least(src, dst) AS source, greatest(src, dst) AS target,
    coalesce(max(sim) FILTER (src < dst), max(sim) FILTER (src > dst)) AS weight
  FROM edges GROUP BY 1, 2)"""


@query("symmetric_edges", f"WITH {SYMMETRIC} SELECT source, target, weight FROM sym")
def symmetric_edges(spark, sf_dir):
    return G.symmetric_edges(quantity_edges(spark, sf_dir))


@query(
    "modularity",
    f"""WITH {SYMMETRIC}, tot AS (SELECT sum(weight) AS m FROM sym),
    memb AS (
      SELECT p_partkey AS node, 0 AS level, p_type AS cluster_id FROM part
      UNION ALL SELECT p_partkey, 1, p_brand FROM part),
    ends AS (SELECT source AS node, weight FROM sym UNION ALL SELECT target, weight FROM sym),
    deg AS (SELECT level, cluster_id, sum(weight) AS d FROM ends JOIN memb USING (node) GROUP BY 1, 2),
    ins AS (SELECT a.level, a.cluster_id, sum(weight) AS w FROM sym JOIN memb a ON a.node = source
      JOIN memb b ON b.node = target AND a.level = b.level AND a.cluster_id = b.cluster_id GROUP BY 1, 2)
    SELECT level, round(sum(coalesce(w, 0) / m - pow(d / (2 * m), 2)), 6) + 0.0 AS modularity,
      count(*) AS n_clusters
    FROM deg LEFT JOIN ins USING (level, cluster_id), tot GROUP BY level""",
)
def modularity(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    levels = parts.select(
        F.col("p_partkey").alias("node"),
        F.posexplode(F.array("p_type", "p_brand")).alias("level", "cluster_id"),
    )
    # read several times
    edges = cut_lineage(G.symmetric_edges(quantity_edges(spark, sf_dir)))
    found = G.modularity(edges, levels, ["level"])
    return found.withColumn("modularity", F.round("modularity", 6) + F.lit(0.0))


# Three levels over the customers: nation, region, market segment.
LEVELS = """memb AS (
  SELECT c_custkey AS doc_id, 0 AS level, n_name AS cluster_id FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT c_custkey, 1, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey, 2, c_mktsegment FROM customer)"""


def customer_levels(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select(
        F.col("c_custkey").alias("doc_id"),
        F.posexplode(F.array("n_name", "r_name", "c_mktsegment")).alias("level", "cluster_id"),
    )


@query(
    "level_map",
    f"""WITH {LEVELS}, f AS (SELECT cluster_id, min(doc_id) AS first FROM memb WHERE level = 0 GROUP BY 1)
    SELECT f.cluster_id, m.level, m.cluster_id AS other_id FROM f JOIN memb m ON m.doc_id = first AND m.level > 0""",
)
def level_map(spark, sf_dir):
    return G.level_map(customer_levels(spark, sf_dir))


@query(
    "cluster_sub_id",
    f"""WITH {LEVELS}, f AS (SELECT level, cluster_id, min(doc_id) AS first FROM memb GROUP BY 1, 2)
    SELECT f.level, f.cluster_id, t.cluster_id AS top_id,
      row_number() OVER (PARTITION BY f.level, t.cluster_id ORDER BY first) - 1 AS sub_id
    FROM f JOIN memb t ON t.doc_id = first AND t.level = 2""",
)
def cluster_sub_id(spark, sf_dir):
    return G.cluster_sub_id(customer_levels(spark, sf_dir), 2)


def shared_nation_edges(spark, sf_dir):
    """Customers and suppliers as nodes, weighted by the quantity one buys from the other."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy(
        F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target")
    ).agg(F.sum("l_quantity").alias("weight"))


@query("community_levels")
def community_levels(spark, sf_dir):
    return C.community_levels(shared_nation_edges(spark, sf_dir))


@query("best_level")
def best_level(spark, sf_dir):
    edges = cut_lineage(shared_nation_edges(spark, sf_dir))
    levels = C.community_levels(edges)
    return G.best_level(G.modularity(edges, levels, ["level"]))
