"""The registered document queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm import (
    bpe,
    exact_dedup,
    fingerprints,
    language_id,
    license_scan,
    line_dedup,
    merkle,
    ngram_join,
    packing,
    token_files,
    topk_search,
    toxicity,
    vector_codes,
)
from quizlake.llm.columns import lower_ascii


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha_of(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "restored")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "group_id", "n_links", "near_classes", "n_grams")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "second", "ambiguous"
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    sketched = fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))
    return sketched.select(
        "doc_id",
        "n_chars",
        sha_of("edited_text").alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        fingerprints.distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", sha_of("kept_text").alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": text})
    return found.drop("siblings")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_toxicity,
        op2_exact_dedup,
        op3_token_files,
        op4_ngram_join,
        op5_best_fit_packing,
        op6_language_id,
        op7_fingerprints,
        op8_line_dedup,
        op9_license_scan,
        op10_byte_bpe,
        op11_merkle_manifest,
        op12_exact_topk,
        op13_vector_codes,
    ]
    return {query.__name__: query for query in found}
