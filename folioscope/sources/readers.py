"""Readers: bibliographic XML, positional CSV, id and phrase lists, layouts and graphs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources import records as R

CSV_COLUMNS = 14


def read_xml_corpus(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Document rows of article and book records. The schema is explicit, so ids keep leading zeros."""
    branches = [("article", R.ARTICLE_ROW, R.ARTICLE_SCHEMA), ("book", R.BOOK_ROW, R.BOOK_SCHEMA)]
    parts = [
        R.document_fields(spark.read.schema(schema).option("rowTag", tag).format("xml").load(path), branch, strict)
        for branch, tag, schema in branches
    ]
    return parts[0].unionByName(parts[1])


def read_csv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Document rows of the positional table; quoted cells may span lines."""
    schema = ", ".join(f"_c{i} string" for i in range(CSV_COLUMNS))
    rows = spark.read.csv(path, schema=schema, multiLine=True, quote='"', escape='"')
    return R.csv_fields(rows)


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Trimmed non-empty lines of a text file; a missing file gives no rows."""
    try:
        rows = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{name} string")
    return rows.select(T.strip_blanks(F.col("value")).alias(name)).filter(F.length(name) > 0)


def read_id_list(spark: SparkSession, path: str, name: str = "doc_id") -> DataFrame:
    return _lines(spark, path, name).distinct()


def read_phrase_list(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, "phrase")


def read_xy_layout(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Rows (idx, x, y) of a layout.

    With ``numbered``, every line starts with its number, and there may be any number of files. Otherwise it
    is a single file, numbered by line: its splits are in order, so the increasing id follows the lines, and
    the rank makes it dense.
    """
    from folioscope.operators.ordering import global_rank

    lines = spark.read.text(path)
    parts = F.split(F.trim("value"), r"\s+")
    if numbered:
        return lines.filter(F.length(F.trim("value")) > 0).select(
            parts[0].cast("bigint").alias("idx"), parts[1].cast("double").alias("x"), parts[2].cast("double").alias("y")
        )
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    cells = lines.filter(F.length(F.trim("value")) > 0).select(
        "_at", parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y")
    )
    return global_rank(cells, [F.col("_at")], "idx", start=0).select("idx", "x", "y")


NODE_SCHEMA = (
    "_id string, _label string, attvalues struct<attvalue:array<struct<_for:string,_value:string>>>,"
    "position struct<_x:double,_y:double>, `viz:position` struct<_x:double,_y:double>"
)
EDGE_SCHEMA = "_id long, _source string, _target string, _weight double"


def read_graph_xml(spark: SparkSession, path: str, class_name: str = "modularity_class") -> DataFrame:
    """Position and community of every node of a graph file."""
    nodes = spark.read.schema(NODE_SCHEMA).option("rowTag", "node").format("xml").load(path)
    found = F.get(F.filter("attvalues.attvalue", lambda a: a["_for"] == class_name), F.lit(0))
    place = F.coalesce(F.col("position"), F.col("`viz:position`"))
    return nodes.select(
        F.col("_id").alias("node"), place["_x"].alias("x"), place["_y"].alias("y"), found["_value"].alias("class")
    )


def read_graph_edges(spark: SparkSession, path: str) -> DataFrame:
    edges = spark.read.schema(EDGE_SCHEMA).option("rowTag", "edge").format("xml").load(path)
    return edges.select(
        F.col("_source").alias("source"), F.col("_target").alias("target"), F.col("_weight").alias("weight")
    )
