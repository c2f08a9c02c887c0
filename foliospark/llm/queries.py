"""Registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, chat_format, decontaminate, html_extract, language_id, license_scan, line_dedup, mixing, simhash, source_audit, substring_dedup, token_align, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_read(spark, sf_dir, "documents")).drop("places")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, start, n_segments, edits) for each benchmark item found in a document."""
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_read(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.link_figures(_read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_read(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.digests(chat_format.windows(turns.unionByName(probe)))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_decontamination, op3_simhash, op4_toxicity, op5_mixing, op6_line_dedup, op7_language_id, op8_html_extraction, op9_substring_dedup, op10_nearest_neighbours, op11_token_alignment, op12_source_divergence, op13_chat_format)}
ORACLES = {"op1_license_scan": license_scan.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op12_source_divergence": source_audit.ORACLE}
