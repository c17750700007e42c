"""Statistics, ranks and moving averages over the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import numbers as N
from folioscope.operators import ordering as R
from folioscope.operators import stats as O
from folioscope.plans.registry import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def r6(column):
    return F.round(column, 6) + F.lit(0.0)


def rounded(df, *columns, digits=6):
    for name in columns:
        df = df.withColumn(name, F.round(name, digits) + F.lit(0.0))
    return df


@query(
    "stats_basic",
    """SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi
    FROM events GROUP BY event_type""",
)
def stats_basic(spark, sf_dir):
    found = O.stats_basic(events(spark, sf_dir), "value", ["event_type"])
    return rounded(rounded(found, "total", digits=4), "mean")


@query(
    "stats_median",
    "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type",
)
def stats_median(spark, sf_dir):
    return rounded(O.stats_median(events(spark, sf_dir), "value", ["event_type"]), "median")


@query(
    "stats_median_all",
    "SELECT round(median(l_extendedprice), 6) AS median FROM lineitem",
)
def stats_median_all(spark, sf_dir):
    return rounded(O.stats_median(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "median")


@query(
    "stats_variance",
    """SELECT event_type, round(var_samp(value), 6) AS var_samp, round(var_pop(value), 6) AS var_pop,
      round(stddev_samp(value), 6) AS dev_samp, round(stddev_pop(value), 6) AS dev_pop FROM events GROUP BY event_type""",
)
def stats_variance(spark, sf_dir):
    found = O.stats_variance(events(spark, sf_dir), "value", ["event_type"])
    return rounded(found, "var_samp", "var_pop", "dev_samp", "dev_pop")


@query(
    "corr_pearson",
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY l_returnflag""",
)
def corr_pearson(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(O.corr_pearson(lines, "l_quantity", "l_extendedprice", ["l_returnflag"]), "corr")


@query(
    "corr_spearman",
    """WITH r AS (
      SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry
      FROM lineitem) SELECT round(corr(rx, ry), 6) AS corr FROM r""",
)
def corr_spearman(spark, sf_dir):
    return rounded(O.corr_spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "corr")


SCORES = """SELECT event_id, round({}, 6) + 0.0 AS {} FROM events"""


def scores(spark, sf_dir, name):
    found = O.standard_scores(events(spark, sf_dir), "value", ["event_type"])
    return rounded(found.select("event_id", name), name)


@query(
    "deviation",
    SCORES.format("value - avg(value) OVER (PARTITION BY event_type)", "deviation"),
)
def deviation(spark, sf_dir):
    return scores(spark, sf_dir, "deviation")


@query(
    "standardize",
    SCORES.format(
        "(value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type)",
        "standardized",
    ),
)
def standardize(spark, sf_dir):
    return scores(spark, sf_dir, "standardized")


@query(
    "zscore",
    SCORES.format(
        "(value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type)",
        "zscore",
    ),
)
def zscore(spark, sf_dir):
    return scores(spark, sf_dir, "zscore")


@query(
    "rank_avg",
    """SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank
    FROM events""",
)
def rank_avg(spark, sf_dir):
    return R.rank_avg(events(spark, sf_dir), "value").select("event_id", "rank")


@query(
    "moving_avg",
    """SELECT event_id, round(m, 6) AS moving_avg FROM (
      SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events
      WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) WHERE n = 7""",
)
def moving_avg(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "ts", "value")
    found = R.moving_avg(rows, [F.col("ts"), F.col("event_id")], "value", 7)
    return rounded(found.select("event_id", "moving_avg"), "moving_avg")


@query(
    "scale_to_max",
    """SELECT event_id, round(value * 100.0 / max(value) OVER (PARTITION BY event_type), 6) AS scaled FROM events""",
)
def scale_to_max(spark, sf_dir):
    found = O.scale_to_max(events(spark, sf_dir), "value", 100.0, ["event_type"])
    return rounded(found.select("event_id", "scaled"), "scaled")


@query(
    "bounding_box",
    """SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 6) AS width,
      max(o_custkey) - min(o_custkey) AS height FROM orders GROUP BY o_orderpriority""",
)
def bounding_box(spark, sf_dir):
    found = O.bounding_box(orders(spark, sf_dir), "o_totalprice", "o_custkey", ["o_orderpriority"])
    return rounded(found, "width").withColumn("height", F.col("height").cast("bigint"))


@query(
    "math_misc",
    """SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice / l_quantity * 100.0 + 0.5) / 100.0 AS rounded,
      round(pow(1 + l_tax, 3), 6) AS power, round((l_extendedprice - l_quantity) / nullif(l_tax - l_discount, 0), 4)
        + 0.0 AS slope,
      CAST(CASE WHEN l_linenumber > 1 THEN ((l_linenumber - 1) * (l_linenumber)) / 2 ELSE 0 END AS BIGINT) AS range_sum
    FROM lineitem""",
)
def math_misc(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    counted = N.number_range(F.lit(0), F.col("l_linenumber").cast("bigint"))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        N.round_to(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("rounded"),
        F.round(N.power(1 + F.col("l_tax"), 3), 6).alias("power"),
        (
            F.round(N.slope(F.col("l_discount"), F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice")), 4)
            + F.lit(0.0)
        ).alias("slope"),
        F.aggregate(counted, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("range_sum"),
    )


@query(
    "line_intersection",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS ay, l_extendedprice / 1000 AS by_,
      l_discount * 100 AS cy, l_tax * 100 AS dy FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey,
      round((ay - cy) / nullif((ay - cy) - (by_ - dy), 0), 4) + 0.0 AS x,
      round(ay + (by_ - ay) * (ay - cy) / nullif((ay - cy) - (by_ - dy), 0), 4) + 0.0 AS y FROM p""",
)
def line_intersection(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    zero, one = F.lit(0.0), F.lit(1.0)
    a, b = (zero, F.col("l_quantity")), (one, F.col("l_extendedprice") / 1000)
    c, d = (zero, F.col("l_discount") * 100), (one, F.col("l_tax") * 100)
    x, y = N.line_intersection(a, b, c, d)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.round(x, 4) + F.lit(0.0)).alias("x"),
        (F.round(y, 4) + F.lit(0.0)).alias("y"),
    )


@query(
    "grid_cell",
    """SELECT CAST(trunc(o_totalprice / 50000) AS BIGINT) AS cell_x, CAST(trunc(o_custkey / 100.0) AS BIGINT) AS cell_y,
      count(*) AS n FROM orders GROUP BY 1, 2""",
)
def grid_cell(spark, sf_dir):
    cells = N.grid_cell(F.col("o_totalprice"), F.col("o_custkey") / 100.0, 50000, 1)
    rows = orders(spark, sf_dir).select(cells[0].alias("cell_x"), cells[1].alias("cell_y"))
    return rows.groupBy("cell_x", "cell_y").agg(F.count(F.lit(1)).alias("n"))


@query(
    "grid_range",
    """SELECT o_orderkey FROM orders WHERE trunc(o_totalprice / 50000) BETWEEN 2 AND 4
      AND trunc(o_custkey / 100.0) BETWEEN 1 AND 6""",
)
def grid_range(spark, sf_dir):
    cell_x, cell_y = N.grid_cell(F.col("o_totalprice"), F.col("o_custkey") / 100.0, 50000, 1)
    return orders(spark, sf_dir).filter(cell_x.between(2, 4) & cell_y.between(1, 6)).select("o_orderkey")


@query("random_columns")
def random_columns(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id")
    return rows.withColumn("uniform", F.rand(7)).withColumn("normal", F.randn(7))


@query("shuffle")
def shuffle(spark, sf_dir):
    keyed = events(spark, sf_dir).select("event_id", F.rand(11).alias("key"))
    return R.global_rank(keyed, [F.col("key"), F.col("event_id")], "place").select("event_id", "place")
