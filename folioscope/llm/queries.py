"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import (
    alignment,
    byte_bpe,
    decontamination,
    language_id,
    license_scans,
    merkle,
    packing,
    periodic_runs,
    secret_scans,
    sharding,
    simhash,
    substring_dedup,
    twins,
    url_filters,
)
from folioscope.llm.templates import LICENSES

SHARDS = 24
RANKS = "byte_bpe_multi_50k.tiktoken"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The id that ends a document in a sequence.
END_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(LICENSES, "license_id string, text string")
    found = license_scans.find_licenses(table(spark, sf_dir, "documents", "doc_id", "text"), templates)
    return found.select("doc_id", "line", "license_id", "n_shared", "dice")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"), digests=True)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(twins.URL_RULES, "host string, path string, verdict string")
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents", "doc_id", "text"), SHARDS)
    law = {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    return placed.withColumns(law).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontamination.contained(table(spark, sf_dir, "documents", "doc_id", "text"), items).drop("key")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    profiles = language_id.learn(docs.filter(remainder != 2))
    told = language_id.predict(docs.select("doc_id", "text"), profiles)
    return told.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return alignment.link_counts(docs, public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_TOKENIZER), END_ID)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = (
    op1_license_scans,
    op2_simhash,
    op3_substring_dedup,
    op4_url_filters,
    op5_sharding,
    op6_byte_bpe,
    op7_document_fingerprints,
    op8_decontamination,
    op9_secret_scans,
    op10_language_id,
    op11_cross_tokenizer_alignment,
    op12_packing,
    op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {run.__name__: run for run in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {
        "op1_license_scans": twins.LICENSE_SCANS,
        "op4_url_filters": twins.URL_FILTERS,
        "op7_document_fingerprints": twins.FINGERPRINTS,
        "op8_decontamination": twins.DECONTAMINATION,
    }
