"""Cluster summaries, similarity, silhouettes, linkage and k-means over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import clusters as O
from folioscope.operators import phrases as P
from folioscope.plans import sqltext as S
from folioscope.plans.registry import query, table
from folioscope.plans.text_queries import CLEAN, dealt_documents
from folioscope.plans.vector_queries import CENTRES, VEC, label_centres, r6, vectors

# Layout: the first two dimensions. Levels: the label, and the label's half.
MEMBERS = f"""{VEC},
memb AS (
  SELECT doc_id, 0 AS level, label AS cluster_id FROM vec
  UNION ALL SELECT doc_id, 1, label // 2 FROM vec
  UNION ALL SELECT doc_id, 2, label // 5 FROM vec)"""


def members(spark, sf_dir):
    label = F.col("label")
    levels = F.array(label, F.floor(label / 2).cast("int"), F.floor(label / 5).cast("int"))
    return vectors(spark, sf_dir).select("doc_id", F.posexplode(levels).alias("level", "cluster_id"))


def layout(spark, sf_dir):
    return vectors(spark, sf_dir).select(
        "doc_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"), "vector"
    )


def relevant_ids(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


@query(
    "cluster_summary",
    f"""WITH {MEMBERS}, s AS (SELECT level, cluster_id, count(*) AS size, round(avg(v[1]), 6) + 0.0 AS center_x,
      round(avg(v[2]), 6) + 0.0 AS center_y FROM memb JOIN vec USING (doc_id) GROUP BY 1, 2),
    m AS (SELECT level, cluster_id, dim, round(avg(x), 6) + 0.0 AS mean FROM memb JOIN cell USING (doc_id)
      GROUP BY 1, 2, 3)
    SELECT level, cluster_id, size, center_x, center_y, dim, mean FROM s JOIN m USING (level, cluster_id)""",
)
def cluster_summary(spark, sf_dir):
    found = O.cluster_summary(layout(spark, sf_dir), members(spark, sf_dir))
    rows = found.select("level", "cluster_id", "size", "center_x", "center_y", F.posexplode("vector").alias("dim", "mean"))
    return rows.select(
        "level", "cluster_id", "size", r6(F.col("center_x")).alias("center_x"), r6(F.col("center_y")).alias("center_y"),
        F.col("dim").cast("bigint").alias("dim"), r6(F.col("mean")).alias("mean"),
    )


@query(
    "cluster_highlights",
    f"""WITH {MEMBERS}
    SELECT level, cluster_id, count(l.doc_id) AS n_relevant FROM memb m
    LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id) GROUP BY 1, 2""",
)
def cluster_highlights(spark, sf_dir):
    return O.cluster_highlights(members(spark, sf_dir), relevant_ids(spark, sf_dir))[0]


@query(
    "cluster_highlight_members",
    f"""WITH {MEMBERS} SELECT level, cluster_id, doc_id FROM memb
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def cluster_highlight_members(spark, sf_dir):
    return O.cluster_highlights(members(spark, sf_dir), relevant_ids(spark, sf_dir))[1]


@query(
    "cluster_similarity",
    f"""WITH {MEMBERS}, c AS (SELECT level, cluster_id, list(m ORDER BY dim) AS v FROM (
      SELECT level, cluster_id, dim, avg(x) AS m FROM memb JOIN cell USING (doc_id) GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT a.level, a.cluster_id AS i, b.cluster_id AS j,
      CASE WHEN a.cluster_id = b.cluster_id THEN 1.0 ELSE round(list_cosine_similarity(a.v, b.v), 6) + 0.0 END AS sim
    FROM c a JOIN c b ON a.level = b.level""",
)
def cluster_similarity(spark, sf_dir):
    summary = O.cluster_summary(layout(spark, sf_dir), members(spark, sf_dir))
    return O.cluster_similarity(summary).withColumn("sim", r6(F.col("sim")))


@query(
    "silhouette",
    f"""WITH {MEMBERS}, lv AS (SELECT level, cluster_id, doc_id, v FROM memb JOIN vec USING (doc_id)),
    d AS (SELECT a.level, a.doc_id, a.cluster_id AS own, b.cluster_id AS other,
      sum(pow(list_distance(a.v, b.v), 2)) AS s, count(*) AS n
      FROM lv a JOIN lv b ON a.level = b.level GROUP BY 1, 2, 3, 4),
    ab AS (SELECT level, doc_id, own, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a,
      min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY 1, 2, 3)
    SELECT level, doc_id, own AS cluster_id, round(coalesce((b - a) / greatest(a, b), 0), 6) + 0.0 AS silhouette FROM ab""",
)
def silhouette(spark, sf_dir):
    found = O.silhouette(vectors(spark, sf_dir), members(spark, sf_dir))
    return found.withColumn("silhouette", r6(F.col("silhouette")))


@query(
    "cluster_separation",
    f"""WITH {MEMBERS}, p AS (SELECT level, cluster_id, doc_id, v[1] AS x, v[2] AS y FROM memb JOIN vec USING (doc_id)),
    r AS (SELECT unnest([1.0, 2.0])::DOUBLE AS rate)
    SELECT doc_id, level, rate,
      round(x + rate * (avg(x) OVER (PARTITION BY level, cluster_id, rate) - (SELECT avg(v[1]) FROM vec)), 6) + 0.0 AS x,
      round(y + rate * (avg(y) OVER (PARTITION BY level, cluster_id, rate) - (SELECT avg(v[2]) FROM vec)), 6) + 0.0 AS y
    FROM p, r""",
)
def cluster_separation(spark, sf_dir):
    moved = O.cluster_separation(layout(spark, sf_dir), members(spark, sf_dir))
    return moved.withColumn("x", r6(F.col("x"))).withColumn("y", r6(F.col("y")))


@query(
    "graph_center",
    f"WITH {VEC} SELECT round(avg(v[1]), 6) + 0.0 AS center_x, round(avg(v[2]), 6) + 0.0 AS center_y FROM vec",
)
def graph_center(spark, sf_dir):
    centre = O.graph_center(layout(spark, sf_dir))
    return centre.select(r6(F.col("center_x")).alias("center_x"), r6(F.col("center_y")).alias("center_y"))


# Points to link: the months of the line items, described by four means; a cluster is a year.
MONTHS = """months AS (
  SELECT year(l_shipdate)::BIGINT AS cluster_id, month(l_shipdate) AS m,
    [avg(l_quantity), avg(l_extendedprice) / 1000, avg(l_discount) * 100, avg(l_tax) * 100] AS v
  FROM lineitem GROUP BY 1, 2)"""


def monthly_points(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    means = lines.groupBy(
        F.year("l_shipdate").cast("bigint").alias("cluster_id"), F.month("l_shipdate").alias("m")
    ).agg(
        F.array(
            F.avg("l_quantity"), F.avg("l_extendedprice") / 1000, F.avg("l_discount") * 100, F.avg("l_tax") * 100
        ).alias("vector")
    )
    return means


PAIR_LINK = f"""WITH {MONTHS} SELECT a.cluster_id AS a, b.cluster_id AS b, round({{}}(list_distance(a.v, b.v)), 6) AS distance
    FROM months a JOIN months b ON a.cluster_id < b.cluster_id GROUP BY 1, 2"""
MEAN_LINK = f"""{MONTHS}, c AS (SELECT cluster_id, count(*) AS n, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] AS v
    FROM months GROUP BY 1),
  ward AS (SELECT a.cluster_id AS a, b.cluster_id AS b, list_distance(a.v, b.v) AS d,
    list_distance(a.v, b.v) * sqrt(2.0 * a.n * b.n / (a.n + b.n)) AS w, a.n AS na, b.n AS nb, a.v AS va, b.v AS vb
    FROM c a JOIN c b ON a.cluster_id < b.cluster_id)"""


def linkage(spark, sf_dir, method):
    found = O.cluster_linkage(monthly_points(spark, sf_dir), method)
    return found.withColumn("distance", F.round("distance", 6))


@query("cluster_linkage_single", PAIR_LINK.format("min"))
def linkage_single(spark, sf_dir):
    return linkage(spark, sf_dir, "single")


@query("cluster_linkage_complete", PAIR_LINK.format("max"))
def linkage_complete(spark, sf_dir):
    return linkage(spark, sf_dir, "complete")


@query("cluster_linkage_average", PAIR_LINK.format("avg"))
def linkage_average(spark, sf_dir):
    return linkage(spark, sf_dir, "average")


@query("cluster_linkage_centroid", f"WITH {MEAN_LINK} SELECT a, b, round(d, 6) AS distance FROM ward")
def linkage_centroid(spark, sf_dir):
    return linkage(spark, sf_dir, "centroid")


@query("cluster_linkage", f"WITH {MEAN_LINK} SELECT a, b, round(w, 6) AS distance FROM ward")
def linkage_ward(spark, sf_dir):
    return linkage(spark, sf_dir, "ward")


@query(
    "merge_step",
    f"""WITH {MEAN_LINK}, best AS (SELECT * FROM ward ORDER BY w, a, b LIMIT 1)
    SELECT a, b, round(w, 6) AS distance, na + nb AS size, unnest(range(4)) AS dim,
      round(unnest([(na * va[1] + nb * vb[1]) / (na + nb), (na * va[2] + nb * vb[2]) / (na + nb),
        (na * va[3] + nb * vb[3]) / (na + nb), (na * va[4] + nb * vb[4]) / (na + nb)]), 6) AS mean FROM best""",
)
def merge_step(spark, sf_dir):
    merged = O.merge_step(monthly_points(spark, sf_dir))
    rows = merged.select("a", "b", F.round("distance", 6).alias("distance"), "size", F.posexplode("vector").alias("dim", "mean"))
    return rows.withColumn("dim", F.col("dim").cast("bigint")).withColumn("mean", F.round("mean", 6))


ASSIGNED = f"""{CENTRES},
gaps AS (SELECT doc_id, centre.label AS label, list_distance(v, c) AS d FROM vec, centre),
assigned AS (SELECT doc_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, label) AS r FROM gaps) WHERE r = 1)"""


def start_centres(spark, sf_dir):
    return label_centres(spark, sf_dir).select(F.col("point_id").cast("int").alias("label"), "vector")


@query("kmeans_assign", f"WITH {ASSIGNED} SELECT doc_id, label FROM assigned")
def kmeans_assign(spark, sf_dir):
    return O.kmeans_assign(vectors(spark, sf_dir), start_centres(spark, sf_dir)).select("doc_id", "label")


@query(
    "kmeans_update",
    f"""WITH {ASSIGNED}, m AS (SELECT a.label, dim, avg(x) AS x FROM assigned a JOIN cell USING (doc_id) GROUP BY 1, 2),
    old AS (SELECT label, unnest(c) AS x, unnest(range(len(c))) AS dim FROM centre)
    SELECT label, dim, round(coalesce(m.x, old.x), 6) + 0.0 AS value FROM old LEFT JOIN m USING (label, dim)""",
)
def kmeans_update(spark, sf_dir):
    centres = start_centres(spark, sf_dir)
    moved = O.kmeans_update(O.kmeans_assign(vectors(spark, sf_dir), centres), centres)
    rows = moved.select("label", F.posexplode("vector").alias("dim", "value"))
    return rows.select("label", F.col("dim").cast("bigint").alias("dim"), r6(F.col("value")).alias("value"))


@query("kmeans")
def kmeans(spark, sf_dir):
    return O.kmeans(vectors(spark, sf_dir))[0]


@query("kmeans_1d")
def kmeans_1d(spark, sf_dir):
    return O.kmeans_1d(table(spark, sf_dir, "events"), "value", [F.col("event_id")], 5)


# Clusters of documents: the source on the fine level, the language on the coarse one.
DOC_MEMBERS = """memb AS (SELECT doc_id, 0 AS level, source AS cluster_id FROM documents
  UNION ALL SELECT doc_id, 1, lang FROM documents)"""


@query(
    "cluster_keywords",
    f"""WITH {CLEAN}, {S.phrase_rows('clean').replace('phr AS', 'dphr AS')}, {DOC_MEMBERS},
    phr AS (SELECT level, cluster_id, phrase, n_words FROM dphr JOIN memb USING (doc_id)),
    {S.score_rows('level, cluster_id')}
    SELECT * FROM (SELECT level, cluster_id,
      row_number() OVER (PARTITION BY level, cluster_id ORDER BY score DESC, phrase) AS rank, phrase, score FROM scored)
    WHERE rank <= 30""",
)
def cluster_keywords(spark, sf_dir):
    levels = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.array("source", "lang")).alias("level", "cluster_id")
    )
    return P.cluster_keywords(dealt_documents(spark, sf_dir), levels)


@query(
    "cluster_text",
    f"""WITH {CLEAN}, {S.phrase_rows('clean').replace('phr AS', 'dphr AS')}, {DOC_MEMBERS}
    SELECT level, cluster_id, phrase, count(*) AS times FROM dphr JOIN memb USING (doc_id) GROUP BY 1, 2, 3""",
)
def cluster_text(spark, sf_dir):
    levels = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.array("source", "lang")).alias("level", "cluster_id")
    )
    return P.cluster_phrases(dealt_documents(spark, sf_dir), levels)
