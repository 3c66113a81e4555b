"""The registered queries on the operators of this subpackage, and their DuckDB twins where SQL can state them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, ship_package
from . import ann, collisions, html, importance, licenses, merkle, minhash, mixing, packing, phrases, rules, sharding, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_archives(warc.plan_records(_read(spark, sf_dir, "pages")), path)
    return warc.records(warc.read_chunks(spark, path, with_data=False)).select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"), "target_uri")


def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"))


def op5_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", "url", html.main_text("html").alias("text")).select(
        "*", F.length("text").cast("long").alias("n_chars"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("blocks")


def op9_importance_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.weigh(docs, importance.fit(docs, _read(spark, sf_dir, "labels"))).select(
        F.col("row.doc_id").alias("doc_id"), "log_weight", "key", "kept")


N_SHARDS = 40


def op10_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("row.text").cast("binary"), F.lit(b""))
    return sharding.shuffle_into_shards(_read(spark, sf_dir, "documents"), N_SHARDS).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op11_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(_read(spark, sf_dir, "documents"), changed, change={"n_chars": F.col("n_chars") + 1})


def op13_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_duplicates(_read(spark, sf_dir, "embeddings"))


def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f) for f in (
        op1_warc_chunks, op2_multiprobe_neighbours, op3_minhash_components, op4_source_mix, op5_text_density,
        op6_best_fit_packing, op7_quality_rules, op8_license_scan, op9_importance_classifier, op10_hypergeometric_shards,
        op11_phrase_streams, op12_merkle_manifest, op13_collision_counting)}

ORACLE: dict[str, str] = {"op1_warc_chunks": warc.ORACLE_RECORDS, "op4_source_mix": mixing.ORACLE_MIX,
                          "op7_quality_rules": rules.oracle(), "op11_phrase_streams": phrases.ORACLE_PHRASES,
                          "op12_merkle_manifest": merkle.oracle()}
