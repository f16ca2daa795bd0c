"""Registered queries of the training-data operators, and their SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nutriyield.llm import (bestfit_rows, byte_bpe, importance, interpolated_lm, language_bits, length_buckets, near_dups, part_codes,
                            pivot_topk, quality_lines, scaled_sketch, toxicity_gru, whitening)
from nutriyield.llm.common import documents, held_out
from nutriyield.llm.vectors import embeddings


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.pack_buckets(documents(spark, sf_dir))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.clean_lines(documents(spark, sf_dir)).select(*quality_lines.QUERY_COLUMNS)


def op3_bestfit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_rows.pack_rows(documents(spark, sf_dir))


def op4_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = held_out(F.col("doc_id"), 4, 2)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    net = toxicity_gru.fit(docs, labels.where(~held))
    return toxicity_gru.score_toxicity(docs, net).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_windows")


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_documents(documents(spark, sf_dir), held_out(F.col("doc_id"), 7, 2), order=3)


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.edit_report(documents(spark, sf_dir))


def op7_language_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    filters = language_bits.learn(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    found = language_bits.identify(docs, filters)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "margin")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(documents(spark, sf_dir)).drop("ids")


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir))


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return importance.resample(documents(spark, sf_dir), labels.where("quality = 1").select("doc_id"))


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(embeddings(spark, sf_dir))


def op12_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_products(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


def op13_limb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.compress(embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_length_buckets, op2_line_rules, op3_bestfit_rows, op4_toxicity_gru, op5_deleted_interpolation, op6_scaled_sketch,
    op7_language_bits, op8_byte_bpe, op9_circulant_minhash, op10_importance,
    op11_jacobi_whitening, op12_voronoi_topk, op13_limb_codes)}

ORACLE: dict[str, str] = {
    "op1_length_buckets": length_buckets.oracle(),
    "op2_line_rules": quality_lines.oracle(),
    "op12_voronoi_topk": pivot_topk.oracle(),
    "op13_limb_codes": part_codes.oracle(),
}
