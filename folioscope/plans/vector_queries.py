"""Dense vectors: distances, arithmetic, scaling, active dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import vectors as V
from folioscope.operators import vectors as O
from folioscope.plans.registry import query, table
from folioscope.session import scratch_path
from folioscope.sources import writers


def vectors(spark, sf_dir):
    """Document vectors: the embeddings as doubles."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("doc_id"), V.as_doubles(F.col("embedding")).alias("vector"), "label")


def r6(column):
    """Six digits, without a negative zero."""
    return F.round(column, 6) + F.lit(0.0)


def long_form(df, out="value"):
    rows = df.select("doc_id", F.posexplode("vector").alias("dim", out))
    return rows.withColumn(out, r6(F.col(out))).withColumn("dim", F.col("dim").cast("bigint"))


# twins: one row per document and dimension
VEC = """vec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings),
cell AS (SELECT doc_id, label, unnest(v) AS x, unnest(range(len(v))) AS dim FROM vec)"""
# twins: a fixed direction, taken from the data: the mean vector
MEAN = "mean AS (SELECT list(m ORDER BY dim) AS mv FROM (SELECT dim, avg(x) AS m FROM cell GROUP BY dim))"


def mean_vector(docs):
    """The mean vector as a scalar: d numbers."""
    rows = docs.select(F.posexplode("vector").alias("dim", "value"))
    means = rows.groupBy("dim").agg(F.avg("value").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m")))
    return means.agg(F.transform(ordered, lambda s: s["m"]).alias("mean")).scalar()


def against_mean(spark, sf_dir):
    docs = vectors(spark, sf_dir)
    return docs.withColumn("m", mean_vector(docs))


@query(
    "dimension_range",
    f"""WITH {VEC} SELECT dim, round(min(x), 6) + 0.0 AS lo, round(max(x), 6) + 0.0 AS hi,
      round(max(x) - min(x), 6) AS difference FROM cell GROUP BY dim""",
)
def dimension_range(spark, sf_dir):
    stats = O.dimension_range(vectors(spark, sf_dir))
    return stats.select(
        F.col("dim").cast("bigint").alias("dim"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"),
        F.round("difference", 6).alias("difference"),
    )


@query(
    "minmax_per_dim",
    f"""WITH {VEC} SELECT doc_id, dim, round((x - min(x) OVER (PARTITION BY dim))
      / (max(x) OVER (PARTITION BY dim) - min(x) OVER (PARTITION BY dim)), 6) + 0.0 AS value FROM cell""",
)
def minmax_per_dim(spark, sf_dir):
    return long_form(O.minmax_per_dim(vectors(spark, sf_dir)))


@query(
    "minmax_per_doc",
    f"""WITH {VEC} SELECT doc_id, dim, round((x - min(x) OVER (PARTITION BY doc_id))
      / (max(x) OVER (PARTITION BY doc_id) - min(x) OVER (PARTITION BY doc_id)), 6) + 0.0 AS value FROM cell""",
)
def minmax_per_doc(spark, sf_dir):
    return long_form(vectors(spark, sf_dir).withColumn("vector", V.minmax_within(F.col("vector"))))


@query(
    "l2_normalize",
    f"""WITH {VEC} SELECT doc_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) + 0.0 AS by_doc,
      round(x / sqrt(sum(x * x) OVER (PARTITION BY dim)), 6) + 0.0 AS by_dim FROM cell""",
)
def l2_normalize(spark, sf_dir):
    docs = vectors(spark, sf_dir)
    both = O.l2_per_dim(O.l2_normalize(docs, out="unit"), out="column")
    rows = both.select("doc_id", F.posexplode(F.arrays_zip("unit", "column")).alias("dim", "p"))
    return rows.select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), r6(F.col("p.unit")).alias("by_doc"),
        r6(F.col("p.column")).alias("by_dim"),
    )


@query(
    "active_dims",
    f"""WITH {VEC},
    chosen AS (SELECT dim FROM cell GROUP BY dim ORDER BY max(x) - min(x) DESC, dim LIMIT 50),
    kept AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY dim) - 1 AS pos
             FROM cell WHERE dim IN (SELECT dim FROM chosen))
    SELECT doc_id, pos, round(x, 6) + 0.0 AS value FROM kept""",
)
def active_dims(spark, sf_dir):
    docs = O.active_dims(vectors(spark, sf_dir), 50)
    rows = docs.select("doc_id", F.posexplode("active").alias("pos", "value"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("value")).alias("value"))


PAIRED = f"""WITH {VEC}, {MEAN}, pair AS (SELECT doc_id, v, mv FROM vec, mean)"""


@query(
    "cosine_similarity",
    PAIRED + " SELECT doc_id, round(list_cosine_similarity(v, mv), 6) + 0.0 AS sim FROM pair",
)
def cosine_similarity(spark, sf_dir):
    return against_mean(spark, sf_dir).select("doc_id", r6(V.cosine(F.col("vector"), F.col("m"))).alias("sim"))


@query(
    "dist_euclidean",
    PAIRED + " SELECT doc_id, round(list_distance(v, mv), 6) AS distance FROM pair",
)
def dist_euclidean(spark, sf_dir):
    return against_mean(spark, sf_dir).select(
        "doc_id", F.round(V.euclidean(F.col("vector"), F.col("m")), 6).alias("distance")
    )


@query(
    "dist_manhattan",
    PAIRED + """ SELECT doc_id, round(list_sum(list_transform(list_zip(v, mv), lambda p: abs(p[1] - p[2]))), 6)
      AS distance FROM pair""",
)
def dist_manhattan(spark, sf_dir):
    return against_mean(spark, sf_dir).select(
        "doc_id", F.round(V.manhattan(F.col("vector"), F.col("m")), 6).alias("distance")
    )


@query(
    "dist_haversine",
    """WITH g AS (SELECT vec_id AS doc_id, embedding[1]::DOUBLE * 180 AS lon1, embedding[2]::DOUBLE * 90 AS lat1,
      embedding[3]::DOUBLE * 180 AS lon2, embedding[4]::DOUBLE * 90 AS lat2 FROM embeddings)
    SELECT doc_id, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)
      + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))), 4) AS km FROM g""",
)
def dist_haversine(spark, sf_dir):
    v = F.col("vector")
    km = V.haversine(v[0] * 180, v[1] * 90, v[2] * 180, v[3] * 90)
    return vectors(spark, sf_dir).select("doc_id", F.round(km, 4).alias("km"))


@query(
    "vector_arith",
    PAIRED + """, f AS (SELECT doc_id, list_dot_product(v, mv) AS d,
        sqrt(list_dot_product(v, v)) AS len, sqrt(list_dot_product(mv, mv)) AS mlen,
        list_transform(list_zip(v, mv), lambda p: p[1] + p[2]) AS plus,
        list_transform(list_zip(v, mv), lambda p: p[1] - p[2]) AS minus,
        list_max(v) AS hi, list_min(v) AS lo, v FROM pair)
    SELECT doc_id, round(d, 6) + 0.0 AS dot, round(len, 6) AS length, round(list_sum(plus), 6) + 0.0 AS sum_add,
      round(list_sum(minus), 6) + 0.0 AS sum_subtract, round(list_sum(list_transform(v, lambda x: x * 3)), 6) + 0.0
        AS sum_scale, round(list_sum(list_transform(v, lambda x: x / len)), 6) + 0.0 AS sum_unit,
      round(acos(greatest(-1.0, least(1.0, d / (len * mlen)))), 6) AS angle,
      round(CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END, 6) AS largest,
      list_position(v, hi)::BIGINT AS index_of_max,
      list_sum(list_transform(v, lambda x: floor(x * 10 + 0.5))) + 0.0 AS sum_rounded FROM f""",
)
def vector_arith(spark, sf_dir):
    v, m = F.col("vector"), F.col("m")
    return against_mean(spark, sf_dir).select(
        "doc_id",
        r6(V.dot(v, m)).alias("dot"),
        F.round(V.norm(v), 6).alias("length"),
        r6(V.total(V.add(v, m))).alias("sum_add"),
        r6(V.total(V.subtract(v, m))).alias("sum_subtract"),
        r6(V.total(V.scale(v, 3.0))).alias("sum_scale"),
        r6(V.total(V.unit(v))).alias("sum_unit"),
        F.round(V.angle(v, m), 6).alias("angle"),
        F.round(V.largest(v), 6).alias("largest"),
        V.index_of(v, F.array_max(v)).alias("index_of_max"),
        (V.total(V.rounded(V.scale(v, 10.0))) + 0.0).alias("sum_rounded"),
    )


@query(
    "vector_predicates",
    PAIRED + """ SELECT doc_id, abs(list_cosine_similarity(v, mv)) <= 0.000001
        / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(mv, mv))) AS perpendicular,
      list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - v[i] * 1.0))) <= 0.000001 AS equal_self,
      list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - mv[i]))) <= 0.000001 AS equal_mean,
      list_cosine_similarity(v, list_transform(v, lambda x: x * 2.0)) > 0.999999 AS parallel_double,
      list_cosine_similarity(v, list_transform(v, lambda x: -x)) < -0.999999 AS antiparallel_negative FROM pair""",
)
def vector_predicates(spark, sf_dir):
    v, m = F.col("vector"), F.col("m")
    close = lambda test: test.cast("boolean")
    return against_mean(spark, sf_dir).select(
        "doc_id",
        close(V.is_perpendicular(v, m)).alias("perpendicular"),
        close(V.nearly_equal(v, V.scale(v, 1.0))).alias("equal_self"),
        close(V.nearly_equal(v, m)).alias("equal_mean"),
        close(V.is_parallel(v, V.scale(v, 2.0))).alias("parallel_double"),
        close(V.is_antiparallel(v, V.scale(v, -1.0))).alias("antiparallel_negative"),
    )


@query(
    "nearest_docs",
    PAIRED + """ SELECT doc_id, round(list_cosine_similarity(v, mv), 6) + 0.0 AS sim FROM pair
      ORDER BY list_cosine_similarity(v, mv) DESC, doc_id LIMIT 25""",
)
def nearest_docs(spark, sf_dir):
    docs = vectors(spark, sf_dir)
    found = O.nearest_docs(docs, mean_vector(docs), 25)
    return found.select("doc_id", r6(F.col("sim")).alias("sim"))


CENTRES = f"""{VEC},
centre AS (SELECT label, list(m ORDER BY dim) AS c FROM (
  SELECT label, dim, avg(x) AS m FROM cell GROUP BY label, dim) GROUP BY label)"""


def label_centres(spark, sf_dir):
    """Mean vector per label."""
    rows = vectors(spark, sf_dir).select("label", F.posexplode("vector").alias("dim", "value"))
    means = rows.groupBy("label", "dim").agg(F.avg("value").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m")))
    return means.groupBy(F.col("label").cast("bigint").alias("point_id")).agg(
        F.transform(ordered, lambda s: s["m"]).alias("vector")
    )


@query(
    "pairwise_distance",
    f"""WITH {CENTRES} SELECT a.label::BIGINT AS i, b.label::BIGINT AS j, round(list_distance(a.c, b.c), 6) AS distance
    FROM centre a JOIN centre b ON a.label < b.label""",
)
def pairwise_distance(spark, sf_dir):
    pairs = O.pairwise_distance(label_centres(spark, sf_dir), V.euclidean)
    return pairs.withColumn("distance", F.round("distance", 6))


@query(
    "write_vectors_by_doc",
    f"""WITH {VEC} SELECT dim, doc_id, round(x, 6) + 0.0 AS value FROM cell""",
)
def write_vectors_by_doc(spark, sf_dir):
    path = scratch_path(spark, "by-doc")
    writers.write_vectors_by_doc(vectors(spark, sf_dir), path)
    rows = spark.read.csv(path, header=True, schema="doc_id bigint, value double, dim int")
    return rows.select(F.col("dim").cast("bigint").alias("dim"), "doc_id", r6(F.col("value")).alias("value"))


@query(
    "write_vectors_by_dim",
    f"""WITH {VEC} SELECT doc_id, {", ".join(f"round(v[{i + 1}], 6) + 0.0 AS dimension{i}" for i in range(64))}
    FROM vec""",
)
def write_vectors_by_dim(spark, sf_dir):
    path = scratch_path(spark, "by-dim")
    writers.write_vectors_by_dim(vectors(spark, sf_dir), path, 64)
    fields = ", ".join(["doc_id bigint", *(f"dimension{i} double" for i in range(64))])
    wide = spark.read.csv(path, header=True, schema=fields)
    return wide.select("doc_id", *[r6(F.col(f"dimension{i}")).alias(f"dimension{i}") for i in range(64)])
