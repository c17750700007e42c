"""List, set and record helpers, and long-form matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import collections as A
from folioscope.functions import text as T
from folioscope.operators import collections as O
from folioscope.operators import matrix as M
from folioscope.operators import ordering as R
from folioscope.plans import sqltext as S
from folioscope.plans.registry import dealt_texts, query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def words(spark, sf_dir):
    """Word array per conversation turn."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))


def joined(column):
    return F.array_join(column, " ")


WORDS = f"""t AS (SELECT conv_id, turn, {S.tokens_of('text')} AS w FROM conversations)"""


@query("where", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 50")
def where(spark, sf_dir):
    test = (F.col("event_type") == "purchase") & (F.col("value") > 50)
    return O.where(events(spark, sf_dir), test).select("event_id")


@query("reject", "SELECT event_id FROM events WHERE NOT (event_type = 'purchase' AND value > 50)")
def reject(spark, sf_dir):
    test = (F.col("event_type") == "purchase") & (F.col("value") > 50)
    return O.reject(events(spark, sf_dir), test).select("event_id")


@query(
    "find",
    "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 100 ORDER BY ts, event_id LIMIT 1",
)
def find(spark, sf_dir):
    test = (F.col("event_type") == "error") & (F.col("value") > 100)
    return O.find(events(spark, sf_dir), test, [F.col("ts"), F.col("event_id")]).select("event_id", "value")


@query("pluck", "SELECT p_name FROM part")
def pluck(spark, sf_dir):
    return O.pluck(table(spark, sf_dir, "part"), "p_name")


@query(
    "map",
    f"""WITH {WORDS} SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: upper(x)), ' ') AS upper,
      coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS letters FROM t""",
)
def map_items(spark, sf_dir):
    return words(spark, sf_dir).select(
        "conv_id",
        "turn",
        joined(F.transform("w", F.upper)).alias("upper"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("letters"),
    )


@query(
    "compact",
    """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) AS kept
    FROM documents""",
)
def compact(spark, sf_dir):
    split = F.split(F.col("text"), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(A.compact(split), "\n").alias("kept"))


@query(
    "without",
    f"""WITH {WORDS} SELECT conv_id, turn,
      array_to_string(list_filter(w, lambda x: x NOT IN ('the', 'der', 'la', '.')), ' ') AS kept FROM t""",
)
def without(spark, sf_dir):
    return words(spark, sf_dir).select("conv_id", "turn", joined(A.without(F.col("w"), "the", "der", "la", ".")).alias("kept"))


@query(
    "zip",
    f"""WITH {WORDS}, s AS (SELECT doc_id AS conv_id, string_split(text, ' ') AS x FROM documents),
    z AS (SELECT conv_id, turn, unnest(list_zip(w, x)) AS p FROM t JOIN s USING (conv_id))
    SELECT conv_id, turn, coalesce(p[1], '~') AS a, coalesce(p[2], '~') AS b, count(*) AS times FROM z GROUP BY ALL""",
)
def zip_lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.split("text", " ").alias("x"))
    paired = words(spark, sf_dir).join(docs, "conv_id")
    rows = paired.select("conv_id", "turn", F.explode(F.arrays_zip("w", "x")).alias("p")).select(
        "conv_id", "turn", F.coalesce("p.w", F.lit("~")).alias("a"), F.coalesce("p.x", F.lit("~")).alias("b")
    )
    return rows.groupBy("conv_id", "turn", "a", "b").agg(F.count(F.lit(1)).alias("times"))


@query(
    "first_last_initial_rest",
    f"""WITH {WORDS} SELECT conv_id, turn, array_to_string(w[1:3], ' ') AS first3,
      array_to_string(w[greatest(len(w) - 2, 1):len(w)], ' ') AS last3,
      array_to_string(w[1:greatest(len(w) - 1, 0)], ' ') AS initial,
      array_to_string(w[2:len(w)], ' ') AS rest FROM t""",
)
def first_last(spark, sf_dir):
    w = F.col("w")
    return words(spark, sf_dir).select(
        "conv_id", "turn", joined(A.first_n(w, 3)).alias("first3"), joined(A.last_n(w, 3)).alias("last3"),
        joined(A.initial(w)).alias("initial"), joined(A.rest(w)).alias("rest"),
    )


@query(
    "index_of",
    f"""WITH {WORDS} SELECT conv_id, turn, coalesce(list_position(w, '.'), 0) - 1 AS first_stop,
      CASE WHEN list_contains(w, '.') THEN len(w) - list_position(list_reverse(w), '.') ELSE -1 END AS last_stop FROM t""",
)
def index_of(spark, sf_dir):
    w = F.col("w")
    return words(spark, sf_dir).select(
        "conv_id", "turn", A.index_of(w, F.lit(".")).alias("first_stop"), A.last_index_of(w, F.lit(".")).alias("last_stop")
    )


@query(
    "last_index_of",
    f"""WITH {WORDS}, u AS (SELECT conv_id, turn, unnest(w) AS x, unnest(range(len(w))) AS pos FROM t),
    l AS (SELECT conv_id, turn, w[1] AS head, w FROM t WHERE len(w) > 0)
    SELECT l.conv_id, l.turn, max(pos) AS last_head FROM l JOIN u ON l.conv_id = u.conv_id AND l.turn = u.turn
      AND u.x = head GROUP BY 1, 2""",
)
def last_index_of(spark, sf_dir):
    rows = words(spark, sf_dir).filter(F.size("w") > 0)
    return rows.select("conv_id", "turn", A.last_index_of(F.col("w"), F.col("w")[0]).alias("last_head"))


@query(
    "sorted_index",
    """SELECT count(*) FILTER (value < (SELECT avg(value) FROM events)) AS place FROM events""",
)
def sorted_index(spark, sf_dir):
    mean = events(spark, sf_dir).agg(F.avg("value").alias("m")).scalar()
    rows = events(spark, sf_dir).select("value", mean.alias("mean"))
    return O.sorted_index(rows, "value", F.col("mean"))


@query(
    "uniq",
    """SELECT user_id, event_id, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""",
)
def uniq(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    return O.uniq(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "flatten",
    """SELECT doc_id, word, count(*) AS times FROM (
      SELECT doc_id, unnest(string_split(line, ' ')) AS word FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
    GROUP BY 1, 2""",
)
def flatten(spark, sf_dir):
    nested = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    # a text is smaller than its words with their counts
    rows = dealt_texts(spark, sf_dir).select("doc_id", F.explode(F.flatten(nested)).alias("word"))
    return rows.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("times"))


@query("union_distinct", "SELECT l_partkey AS k FROM lineitem UNION SELECT o_custkey FROM orders")
def union_distinct(spark, sf_dir):
    parts = lines(spark, sf_dir).select(F.col("l_partkey").alias("k"))
    return O.union_distinct(parts, table(spark, sf_dir, "orders").select("o_custkey"))


@query("intersection", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT o_custkey FROM orders")
def intersection(spark, sf_dir):
    parts = lines(spark, sf_dir).select(F.col("l_partkey").alias("k"))
    return O.intersection(parts, table(spark, sf_dir, "orders").select("o_custkey"))


@query(
    "difference",
    "SELECT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT o_custkey FROM orders)",
)
def difference(spark, sf_dir):
    parts = lines(spark, sf_dir).select(F.col("l_partkey").alias("k"))
    return O.difference(parts, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query(
    "group_by",
    """SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
)
def group_by(spark, sf_dir):
    grouped = events(spark, sf_dir).groupBy("event_type", "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "reduce",
    f"""WITH {WORDS} SELECT conv_id, turn, coalesce(list_sum(list_transform(w, lambda x: length(x) * length(x))), 0)::BIGINT
      AS folded FROM t""",
)
def reduce_items(spark, sf_dir):
    fold = F.aggregate("w", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x) * F.length(x))
    return words(spark, sf_dir).select("conv_id", "turn", fold.alias("folded"))


@query(
    "max_by",
    """SELECT event_type, max_by(event_id, (round(value), event_id)) AS max_by, min_by(event_id, (round(value), event_id))
      AS min_by FROM events GROUP BY 1""",
)
def max_by(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v", F.round("value"))
    return O.extremes(rows, ["event_type"], "v", "event_id")


@query(
    "min_by",
    f"""WITH {WORDS}, u AS (SELECT conv_id, turn, unnest(w) AS x, unnest(range(len(w))) AS pos FROM t)
    SELECT conv_id, turn, arg_min(x, length(x) * 100000 + pos) AS shortest,
      arg_max(x, length(x) * 100000 + pos) AS longest FROM u GROUP BY 1, 2""",
)
def min_by(spark, sf_dir):
    rows = words(spark, sf_dir).filter(F.size("w") > 0)
    return rows.select(
        "conv_id", "turn", A.min_by(F.col("w"), F.length).alias("shortest"), A.max_by(F.col("w"), F.length).alias("longest")
    )


@query(
    "any_every",
    """SELECT user_id, bool_or(value > 200) AS "any", bool_and(value > 1) AS "every" FROM events GROUP BY 1""",
)
def any_every(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("user_id")
    return rows.agg(F.bool_or(F.col("value") > 200).alias("any"), F.bool_and(F.col("value") > 1).alias("every"))


@query(
    "contains",
    f"""WITH {WORDS} SELECT conv_id, turn, list_contains(w, 'the') AS has_the,
      len(list_filter(w, lambda x: length(x) > 12)) > 0 AS any_long,
      len(list_filter(w, lambda x: length(x) <= 12)) = len(w) AS every_short FROM t""",
)
def contains(spark, sf_dir):
    w = F.col("w")
    return words(spark, sf_dir).select(
        "conv_id", "turn", F.array_contains(w, "the").alias("has_the"),
        A.any_of(w, lambda x: F.length(x) > 12).alias("any_long"),
        A.every(w, lambda x: F.length(x) <= 12).alias("every_short"),
    )


@query("size", f"WITH {WORDS} SELECT conv_id, turn, len(w) AS size FROM t")
def size(spark, sf_dir):
    return words(spark, sf_dir).select("conv_id", "turn", F.size("w").cast("bigint").alias("size"))


@query("sort", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS place FROM events")
def sort(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "value")
    return R.global_rank(rows, [F.col("value"), F.col("event_id")], "place", start=0).select("event_id", "place")


@query(
    "sort_by",
    f"""WITH {WORDS}, u AS (SELECT conv_id, turn, unnest(w) AS x, unnest(range(len(w))) AS pos FROM t)
    SELECT conv_id, turn, string_agg(x, ' ' ORDER BY length(x), pos) AS ordered FROM u GROUP BY 1, 2""",
)
def sort_by(spark, sf_dir):
    rows = words(spark, sf_dir).filter(F.size("w") > 0)
    return rows.select("conv_id", "turn", joined(A.sort_by(F.col("w"), F.length)).alias("ordered"))


@query(
    "object_ops",
    """WITH e AS (SELECT event_id, 'type' AS k, event_type AS v, 'default' AS d FROM events
      UNION ALL SELECT event_id, 'user', user_id::VARCHAR, 'none' FROM events)
    SELECT event_id, 'k,type,user' AS keys, string_agg(v, ',' ORDER BY k) AS vals,
      'overridden,' || max(v) FILTER (k = 'user') AS merged FROM e GROUP BY event_id""",
)
def object_ops(spark, sf_dir):
    record = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    other = F.create_map(F.lit("type"), F.lit("overridden"))
    fallback = F.create_map(F.lit("type"), F.lit("default"), F.lit("k"), F.lit("none"))
    rows = events(spark, sf_dir).select("event_id", record.alias("m"))
    filled = A.defaults(F.col("m"), fallback)
    merged = A.merge(F.col("m"), other)
    return rows.select(
        "event_id",
        F.array_join(F.sort_array(F.map_keys(filled)), ",").alias("keys"),
        F.array_join(F.map_values(F.col("m")), ",").alias("vals"),
        F.concat_ws(",", F.element_at(merged, "type"), F.element_at(merged, "user")).alias("merged"),
    )


@query(
    "array_sets",
    f"""WITH {WORDS}, p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b
      ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, len(list_distinct(x || y)) AS n_union, len(list_distinct(list_intersect(x, y))) AS n_both,
      len(list_filter(x, lambda q: NOT list_contains(y, q))) AS n_difference, len(list_distinct(x)) AS n_uniq FROM p""",
)
def array_sets(spark, sf_dir):
    a = words(spark, sf_dir).select("conv_id", "turn", F.col("w").alias("x"))
    b = words(spark, sf_dir).select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y"))
    x, y = F.col("x"), F.col("y")

    def count(column):
        return F.size(column).cast("bigint")

    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", count(A.union(x, y)).alias("n_union"), count(A.intersection(x, y)).alias("n_both"),
        count(A.difference(x, y)).alias("n_difference"), count(A.uniq(x)).alias("n_uniq"),
    )


# Matrices: quantity by (supplier, line number) and price by (line number, supplier).
MATRICES = """a AS (SELECT l_suppkey AS i, l_linenumber::BIGINT AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_linenumber::BIGINT AS i, l_suppkey AS j, sum(l_discount) AS v FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2)"""


def matrices(spark, sf_dir):
    rows = lines(spark, sf_dir).select(
        F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("bigint").alias("n"), "l_quantity", "l_discount"
    )
    a = rows.groupBy(F.col("s").alias("i"), F.col("n").alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = rows.groupBy(F.col("n").alias("i"), F.col("s").alias("j")).agg(F.sum("l_discount").alias("v"))
    return a, b


@query(
    "matrix_long_ops",
    f"""WITH {MATRICES},
    bt AS (SELECT j AS i, i AS j, v FROM b),
    plus AS (SELECT i, j, sum(v) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM bt) GROUP BY 1, 2),
    minus AS (SELECT i, j, sum(v) AS v FROM (SELECT * FROM a UNION ALL SELECT i, j, -v FROM bt) GROUP BY 1, 2),
    everything AS (
      SELECT 'product' AS op, i, j, v FROM p UNION ALL SELECT 'transpose', i, j, v FROM bt
      UNION ALL SELECT 'add', i, j, v FROM plus UNION ALL SELECT 'subtract', i, j, v FROM minus
      UNION ALL SELECT 'diagonal', i, i, v FROM p WHERE i = j
      UNION ALL SELECT 'trace', 0, 0, sum(v) FROM p WHERE i = j
      UNION ALL SELECT 'row', 3, j, v FROM a WHERE i = 3
      UNION ALL SELECT 'column', i, 2, v FROM a WHERE j = 2
      UNION ALL SELECT 'largest', 0, 0, max(v) FROM p)
    SELECT op, i, j, round(v, 3) + 0.0 AS v FROM everything""",
)
def matrix_long_ops(spark, sf_dir):
    a, b = matrices(spark, sf_dir)
    bt, product = M.transpose(b), M.multiply(a, b)
    zero, diagonal = F.lit(0).cast("bigint"), M.product_diagonal(a, b)
    parts = {
        "product": product,
        "transpose": bt,
        "add": M.add(a, bt),
        "subtract": M.subtract(a, bt),
        "diagonal": diagonal.select("i", F.col("i").alias("j"), "v"),
        "trace": diagonal.agg(F.sum("v").alias("v")).select(zero.alias("i"), zero.alias("j"), "v"),
        "row": M.row(a, 3).select(F.lit(3).cast("bigint").alias("i"), "j", "v"),
        "column": M.column(a, 2).select("i", F.lit(2).cast("bigint").alias("j"), "v"),
        "largest": M.largest(product).select(zero.alias("i"), zero.alias("j"), F.col("largest").alias("v")),
    }
    tagged = [df.select(F.lit(op).alias("op"), "i", "j", (F.round("v", 3) + F.lit(0.0)).alias("v")) for op, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)
