"""Registration of queries: a Spark callable plus, where SQL can state it, the DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    twin: str | None


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name``; ``sql`` is its twin over the same tables."""

    def add(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = Query(name, fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents with the given columns."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(*columns) if columns else docs


def dealt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts dealt by document, so that counts per document and word or phrase need no shuffle of these.

    The parts are as many as a shuffle has; given as a number, they are not put together to larger ones, and a task holds the counts of few texts.
    """
    return texts(spark, sf_dir, "doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def spread_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts dealt to all tasks, where few splits hold them. Dealt by a hash of the document that no grouping by document matches,
    so that counts of words still pass one shuffle, which all their readers share, instead of being made by each."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return texts(spark, sf_dir, "doc_id", "text").repartition(parts, F.xxhash64("doc_id"))


def registered() -> dict[str, Query]:
    from folioscope.plans import load_all

    load_all()
    return dict(_QUERIES)
