"""Documents to packed training sequences, stage by stage; every stage's result is a table."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm import language_id, line_dedup, ngram_join, packing, toxicity
from quizlake.llm.columns import carried
from quizlake.session import limit_batches, store_once


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier can name; ``und`` and ambiguous ones go.

    A null text, or one without a letter, is ``und`` and goes; so does every document if no language
    could be learned. Rows are judged one by one, repeated ones too; an empty table gives no
    rows. All columns come back as they were, whatever their names.
    """
    limit_batches(spark)
    found = language_id.predict(docs, language_id.train(docs), carry=True)
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous"))
    return kept.select(*carried(docs, "text"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict toxic.

    Null texts count as empty and get the model's bias; repeated rows are judged each; an
    empty table gives no rows. All columns come back as they were, whatever their names.
    """
    limit_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels), carry=True)
    return scored.filter("predicted = 0").select(*carried(docs, "text"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the lines that other documents keep; n_chars follows.

    A document that loses no line comes back as it was, a null text too. Rows of one id are one
    document, a null id is the smallest. An empty table gives no rows. Columns other than the text and
    n_chars come back as they were, whatever their names.
    """
    kept = line_dedup.drop_repeated_lines(docs, carry=True)
    lost = F.col("n_dropped") > 0
    changed = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        size = F.when(lost, F.char_length("kept_text")).otherwise(F.col("others").getField("n_chars"))
        changed["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return kept.select(*carried(docs, "text", changed))


def one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, that of the smallest id.

    Null and empty texts are one group; of repeated rows one stays. An empty table gives no rows.
    All columns come back as they were, whatever their names.
    """
    limit_batches(spark)
    return ngram_join.one_of_each_group(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents left, placed in sequences.

    Null texts count as empty, which is the end mark alone; repeated rows are packed each; an
    empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
    """
    limit_batches(spark)
    return packing.pack_documents(docs, tokenizers.path("byte_bpe_50k.json"), chunk=2_000_000)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_near_duplicate),
    ("best_fit_packing", packed),
]

# The trained stages and the tokenizer cannot be written in SQL; tests compare brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next.

    Null ids and texts, repeated rows, very long texts and an empty table pass as the stages say.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = store_once(docs, f"stage-{name}")
    return docs
