"""Exact duplicates by 128-bit content hash, with the bytes compared inside every hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.columns import text_of, without_blanks

# A row's rank inside its group in one decimal: longer first, then smaller id. A decimal is
# a fixed-width buffer, so the aggregate hashes; a struct would make it sort whole texts.
_SCALE = "20000000000000000000"
_TOP = "9223372036854775808"


def _number(value):
    return (F.lit(value) if isinstance(value, str) else value).cast("decimal(38,0)")


def _rank(n_chars, doc_id):
    smaller_first = F.coalesce(_number(_TOP) - _number(doc_id), _number("0"))
    return (_number(n_chars) * _number(_SCALE) + smaller_first).cast("decimal(38,0)")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id that stays for its text, the group's size, and whether the row stays.

    Texts are equal when identical without blanks (space, tab to carriage return). The row
    with the most code points stays, then the smallest id. Groups form on the hash first and
    on the bytes within it, so a hash collision never joins two texts. Copies collapse before
    the shuffle, so a group of any size costs a row per task.

    Null texts count as empty; all empty texts are one group. A null id ranks behind every
    other. Of rows repeated with the same id and length, one is marked as kept. An empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("raw")).select(
        "doc_id", F.char_length("raw").alias("n_chars"), without_blanks(F.col("raw")).alias("plain")
    )
    hashed = rows.withColumn("hash", F.unhex(F.md5(F.col("plain").cast("binary"))))
    digest = F.sha2(F.col("plain").cast("binary"), 256).alias("text_sha256")
    groups = (
        hashed.groupBy("hash", "plain")
        .agg(F.count("*").alias("group_size"), F.max(_rank(F.col("n_chars"), F.col("doc_id"))).alias("best"))
        .select("hash", digest, "group_size", "best")
        .withColumns(
            {
                "keep_chars": F.call_function("div", F.col("best"), _number(_SCALE)),
                "left_over": F.col("best") % _number(_SCALE),
            }
        )
        .withColumn("keep_id", F.when(F.col("left_over") > 0, (_number(_TOP) - F.col("left_over")).cast("long")))
        .drop("best", "left_over")
    )
    members = hashed.groupBy("doc_id", "n_chars", "hash", digest).agg(F.count("*").alias("times"))
    return (
        members.join(groups, ["hash", "text_sha256"])
        .withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (
                F.col("doc_id").eqNullSafe(F.col("keep_id"))
                & (F.col("n_chars") == F.col("keep_chars"))
                & (F.col("turn") == 1)
            ).alias("kept"),
            "text_sha256",
        )
    )
