"""Brushes, axes and bundles over the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import brushes as O
from folioscope.plans.registry import query, table

DIMS = ["o_totalprice", "o_custkey", "day"]
HEIGHT, WIDTH = 400.0, 120.0


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def axes(spark, sf_dir):
    """Orders with a date axis in days."""
    return orders(spark, sf_dir).select(
        "o_orderkey", "o_totalprice", "o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"),
        "o_orderpriority", "o_orderstatus",
    )


def r6(column):
    return F.round(column, 6) + F.lit(0.0)


AXES = """ax AS (SELECT o_orderkey, o_totalprice, o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day,
  o_orderpriority, o_orderstatus FROM orders)"""


def place(column):
    return (
        f"({HEIGHT + 1} - {HEIGHT} * (({column} - (SELECT min({column}) FROM ax))::DOUBLE"
        f" / (SELECT max({column}) - min({column}) FROM ax)))"
    )


PLACED = f"""{AXES},
pl AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, {place('o_totalprice')} AS p, {place('o_custkey')} AS c,
  {place('day')} AS d FROM ax)"""

DOMAIN = """dom AS (SELECT o_orderpriority AS value, count(*) AS n,
  row_number() OVER (ORDER BY count(*), o_orderpriority) - 1 AS place FROM orders GROUP BY 1)"""


@query("ordinal_domain", f"WITH {DOMAIN} SELECT value, n, place FROM dom")
def ordinal_domain(spark, sf_dir):
    return O.ordinal_domain(orders(spark, sf_dir), "o_orderpriority")


RANGES = {"o_totalprice": (100000.0, 250000.0), "o_custkey": (200, 900)}


@query(
    "brush_axis_and_or",
    f"""WITH {DOMAIN} SELECT 'AND' AS mode, o_orderkey FROM orders JOIN dom ON o_orderpriority = value
    WHERE o_totalprice BETWEEN 100000 AND 250000 AND o_custkey BETWEEN 200 AND 900 AND place BETWEEN 1 AND 3
    UNION ALL SELECT 'OR', o_orderkey FROM orders JOIN dom ON o_orderpriority = value
    WHERE o_totalprice BETWEEN 100000 AND 250000 OR o_custkey BETWEEN 200 AND 900 OR place BETWEEN 1 AND 3
    UNION ALL SELECT 'none', o_orderkey FROM orders""",
)
def brush_axis_and_or(spark, sf_dir):
    rows = orders(spark, sf_dir)
    domain = {"o_orderpriority": O.ordinal_domain(rows, "o_orderpriority")}
    ranges = {**RANGES, "o_orderpriority": (1, 3)}
    parts = [
        O.brush_axis(rows, ranges, "AND", domain).select(F.lit("AND").alias("mode"), "o_orderkey"),
        O.brush_axis(rows, ranges, "OR", domain).select(F.lit("OR").alias("mode"), "o_orderkey"),
        O.brush_axis(rows, {}).select(F.lit("none").alias("mode"), "o_orderkey"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "brush_multi_extent",
    """SELECT o_orderkey FROM orders WHERE (o_totalprice BETWEEN 50000 AND 90000 OR o_totalprice BETWEEN 200000 AND 300000)
    AND (o_custkey BETWEEN 0 AND 100 OR o_custkey BETWEEN 500 AND 800)""",
)
def brush_multi_extent(spark, sf_dir):
    extents = {"o_totalprice": [(50000, 90000), (200000, 300000)], "o_custkey": [(0, 100), (500, 800)]}
    return O.brush_multi_extent(orders(spark, sf_dir), extents).select("o_orderkey")


@query(
    "brush_strum",
    f"""WITH {PLACED}, f AS (SELECT o_orderkey,
      (p + (c - p) * 0.25 - 100) * (p + (c - p) * 0.75 - 320) < 0 AS a,
      (c + (d - c) * 0.5 - 50) * (c + (d - c) * 0.5 - 200) < 0 AS b FROM pl)
    SELECT 'AND' AS mode, o_orderkey FROM f WHERE a AND b
    UNION ALL SELECT 'OR', o_orderkey FROM f WHERE a OR b""",
)
def brush_strum(spark, sf_dir):
    strums = [
        O.Strum("o_totalprice", "o_custkey", (30.0, 100.0), (90.0, 320.0), WIDTH),
        O.Strum("o_custkey", "day", (60.0, 50.0), (60.0, 200.0), WIDTH),
    ]
    rows = axes(spark, sf_dir)
    both = [
        O.brush_strum(rows, strums, HEIGHT, mode).select(F.lit(mode).alias("mode"), "o_orderkey")
        for mode in ("AND", "OR")
    ]
    return both[0].unionByName(both[1])


@query(
    "brush_angle",
    f"""WITH {PLACED}, f AS (SELECT o_orderkey,
      asin((p - c) / sqrt({WIDTH} * {WIDTH} + (p - c) * (p - c))) AS a,
      asin((c - d) / sqrt({WIDTH} * {WIDTH} + (c - d) * (c - d))) AS b FROM pl)
    SELECT o_orderkey FROM f WHERE a BETWEEN -0.5 AND 0.4 AND b BETWEEN -1.2 AND 0.3""",
)
def brush_angle(spark, sf_dir):
    arcs = [O.Arc("o_totalprice", "o_custkey", 0.4, -0.5, WIDTH), O.Arc("o_custkey", "day", -1.2, 0.3, WIDTH)]
    return O.brush_angle(axes(spark, sf_dir), arcs, HEIGHT).select("o_orderkey")


@query("hide_dimensions", "SELECT o_orderkey, o_totalprice FROM orders")
def hide_dimensions(spark, sf_dir):
    hidden = ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
    return O.hide_dimensions(orders(spark, sf_dir), hidden)


@query(
    "highlight_rows",
    """SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AS highlighted
    FROM orders""",
)
def highlight_rows(spark, sf_dir):
    marked = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return O.highlight_rows(orders(spark, sf_dir).select("o_orderkey"), marked, "o_orderkey")


@query(
    "infer_dim_types",
    """WITH t AS (SELECT value::VARCHAR AS value, event_type, ts::VARCHAR AS ts, user_id::VARCHAR AS user_id FROM events)
    SELECT dim, CASE WHEN number = n THEN 'number' WHEN stamp = n THEN 'date' ELSE 'string' END AS type FROM (
      SELECT 'value' AS dim, count(value) AS n, count(try_cast(value AS DOUBLE)) AS number,
        count(try_cast(value AS TIMESTAMP)) AS stamp FROM t
      UNION ALL SELECT 'event_type', count(event_type), count(try_cast(event_type AS DOUBLE)),
        count(try_cast(event_type AS TIMESTAMP)) FROM t
      UNION ALL SELECT 'ts', count(ts), count(try_cast(ts AS DOUBLE)), count(try_cast(ts AS TIMESTAMP)) FROM t
      UNION ALL SELECT 'user_id', count(user_id), count(try_cast(user_id AS DOUBLE)),
        count(try_cast(user_id AS TIMESTAMP)) FROM t)""",
)
def infer_dim_types(spark, sf_dir):
    columns = ["value", "event_type", "ts", "user_id"]
    rows = table(spark, sf_dir, "events").select(*[F.col(c).cast("string").alias(c) for c in columns])
    return O.infer_dim_types(rows, columns)


EXTENTS = """ext AS (
  SELECT 'o_totalprice' AS dim, min(o_totalprice)::DOUBLE AS lo, max(o_totalprice)::DOUBLE AS hi FROM ax
  UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey) FROM ax
  UNION ALL SELECT 'day', min(day), max(day) FROM ax)"""


@query(
    "axis_extent",
    f"""WITH {AXES}, {EXTENTS} SELECT dim, lo, hi FROM ext
    UNION ALL SELECT 'common', min(lo), max(hi) FROM ext""",
)
def axis_extent(spark, sf_dir):
    extents = O.axis_extent(axes(spark, sf_dir), DIMS)
    common = O.common_extent(extents).select(F.lit("common").alias("dim"), "lo", "hi")
    return extents.unionByName(common)


@query(
    "bundle_centroids",
    f"""WITH {PLACED} SELECT o_orderpriority, round(avg(p), 6) AS center_o_totalprice, round(avg(c), 6) AS center_o_custkey,
      round(avg(d), 6) AS center_day FROM pl GROUP BY 1""",
)
def bundle_centroids(spark, sf_dir):
    placed = O.scaled_axes(axes(spark, sf_dir), DIMS, HEIGHT)
    found = O.bundle_centroids(placed, DIMS, "o_orderpriority")
    return found.select("o_orderpriority", *[F.round(f"center_{d}", 6).alias(f"center_{d}") for d in DIMS])


@query(
    "bundle_points",
    f"""WITH {PLACED}, m AS (SELECT *, avg(p) OVER w AS cp, avg(c) OVER w AS cc, avg(d) OVER w AS cd FROM pl
      WINDOW w AS (PARTITION BY o_orderpriority))
    SELECT o_orderkey, 0 AS gap, round((cp + cc) / 2 + 0.3 * ((p + c) / 2 - (cp + cc) / 2), 4) AS y FROM m
    UNION ALL SELECT o_orderkey, 1, round((cc + cd) / 2 + 0.3 * ((c + d) / 2 - (cc + cd) / 2), 4) FROM m""",
)
def bundle_points(spark, sf_dir):
    placed = O.scaled_axes(axes(spark, sf_dir), DIMS, HEIGHT)
    points = O.bundle_points(placed, DIMS, "o_orderpriority", 0.7, ["o_orderkey"])
    return points.select("o_orderkey", "gap", F.round("y", 4).alias("y"))


@query(
    "reorder_dimensions",
    f"""WITH {PLACED}, one AS (SELECT * FROM pl WHERE o_orderkey = (SELECT max(l_orderkey) FROM lineitem)),
    v AS (SELECT 'o_totalprice' AS dim, p AS y FROM one UNION ALL SELECT 'o_custkey', c FROM one
      UNION ALL SELECT 'day', d FROM one)
    SELECT dim, row_number() OVER (ORDER BY y, dim) - 1 AS idx FROM v""",
)
def reorder_dimensions(spark, sf_dir):
    placed = O.scaled_axes(axes(spark, sf_dir), DIMS, HEIGHT)
    chosen = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey").alias("k")).scalar()
    return O.reorder_dimensions(placed, DIMS, F.col("o_orderkey") == chosen)


@query(
    "adjacent_pairs",
    """WITH d AS (SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY 1),
    m AS (SELECT strftime(day, '%Y-%m') AS dim, sum(n) AS n FROM d GROUP BY 1),
    l AS (SELECT dim AS "left", lead(dim) OVER (ORDER BY dim) AS "right" FROM m)
    SELECT "left", "right" FROM l WHERE "right" IS NOT NULL""",
)
def adjacent_pairs(spark, sf_dir):
    months = table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("dim")).count()
    return O.adjacent_pairs(months.select("dim", F.col("dim").alias("idx")))
