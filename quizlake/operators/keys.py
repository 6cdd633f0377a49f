"""Surrogate keys and per-key numbering that no single hot key can pull into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizlake.session import store_once

# Numbering is done in groups of at most 2**SPAN_BITS rows.
SPAN_BITS = 20


def _shift_left_sum(bucket_columns: list[str], within: list[str]) -> Column:
    window = Window.partitionBy(*within) if within else Window
    window = window.orderBy(*bucket_columns).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(window), F.lit(0))


def bucket_digits(spark: SparkSession) -> int:
    """Hexadecimal digits for one bucket a shuffle partition or more, and 4,096 buckets at least.

    Partitions are sized by the data, so a bucket holds no more rows than a partition should.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digits = 3
    while 16**digits < partitions:
        digits += 1
    return digits


def assign_ids(
    rows: DataFrame,
    id_column: str,
    key_columns: list[str],
    position_column: str | None = None,
    existing: DataFrame | None = None,
    hex_digits: int | None = None,
    span_bits: int = SPAN_BITS,
) -> DataFrame:
    """Give each row ``max(existing) + 1, + 2, ...`` without gaps, and the same on every run.

    Rows are ranked by the MD5 of their key, so the first ``hex_digits`` digits cut them into
    16**hex_digits even buckets (``bucket_digits`` unless given). Each bucket is numbered by its
    own task; what precedes a bucket comes from a running sum over the bucket counts, a table of
    at most 16**hex_digits rows times the number of position spans. Rows of one key keep the
    order of ``position_column`` and are cut into spans of 2**span_bits positions, so a key
    that holds a large share of the rows is numbered by many tasks.

    (key, position) must be unique; the ids are then independent of the partitioning, which a
    recomputed task may change, and of ``hex_digits`` while positions stay within one span.
    """
    digits = hex_digits or bucket_digits(rows.sparkSession)
    text_key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_columns]
    key_hash = F.md5(F.concat_ws("/", *text_key))
    bucket = F.conv(F.substring(key_hash, 1, digits), 16, 10).cast("bigint")
    keyed = rows.withColumn("_bucket", bucket)
    buckets = ["_bucket"]
    if position_column:  # a constant span would count as no key, and the rows be dealt out twice
        keyed = keyed.withColumn("_span", F.shiftright(F.col(position_column).cast("bigint"), span_bits))
        buckets.append("_span")
    before = (
        keyed.groupBy(*buckets)
        .agg(F.count("*").alias("_n"))
        .select(*buckets, _shift_left_sum(buckets, []).alias("_before"))
    )
    order = ["_hash", *key_columns] + ([position_column] if position_column else [])
    in_bucket = F.row_number().over(Window.partitionBy(*buckets).orderBy(*order))
    base = F.lit(0).cast("bigint")
    if existing is not None:
        base = F.coalesce(existing.agg(F.max(id_column)).scalar(), base)
    # The hash is long and does not compress: it is made anew behind the exchange.
    return (
        keyed.repartition(*buckets)
        .withColumn("_hash", key_hash)
        .withColumn("_in_bucket", in_bucket)
        .join(before, buckets)
        .withColumn(id_column, (base + F.col("_before") + F.col("_in_bucket")).cast("bigint"))
        .drop("_hash", "_bucket", "_span", "_in_bucket", "_before")
    )


def assign_blocks(
    rows: DataFrame, row_column: str, before_column: str, key: str, size: Column, hex_digits: int | None = None
) -> DataFrame:
    """The distinct ``key`` of each row with its place, from 1, and the sizes of all places before it added up.

    The order is that of ``assign_ids``: member k of a row, from 0, gets the number ``before`` + k + 1 there
    if members are numbered by ``key`` and position. Only keys and sizes are shuffled.
    """
    digits = hex_digits or bucket_digits(rows.sparkSession)
    key_hash = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    bucket = F.conv(F.substring(key_hash, 1, digits), 16, 10).cast("int")
    keyed = rows.select(key, size.cast("bigint").alias("_size"), bucket.alias("_bucket"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"), F.sum("_size").alias("_members"))
    before = sums.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_members").over(earlier), F.lit(0)).alias("_before"),
    )
    in_bucket = Window.partitionBy("_bucket").orderBy("_hash", key)
    above = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.repartition("_bucket")
        .withColumn("_hash", key_hash)
        .withColumns({"_row": F.row_number().over(in_bucket), "_above": F.coalesce(F.sum("_size").over(above), F.lit(0))})
        .join(before, "_bucket")
        .select(
            key,
            (F.col("_rows") + F.col("_row")).cast("bigint").alias(row_column),
            (F.col("_before") + F.col("_above")).cast("bigint").alias(before_column),
        )
    )


def number_within(
    rows: DataFrame, key: str, unique_id: str, number_column: str, span_bits: int = SPAN_BITS
) -> DataFrame:
    """Number the rows of each ``key`` from 1 in the order of the unique integer ``unique_id``.

    A window over the key alone would sort a hot key in one task. Every key is cut into spans
    of 2**span_bits ids, and ids are unique, so no window group is larger than that. Counts of
    the earlier spans of a key are added back; they join on the partitioning the window
    already has.
    """
    cut = rows.withColumn("_span", F.shiftright(F.col(unique_id).cast("bigint"), span_bits))
    before = (
        cut.groupBy(key, "_span")
        .agg(F.count("*").alias("_n"))
        .select(key, "_span", _shift_left_sum(["_span"], [key]).alias("_before"))
    )
    in_span = F.row_number().over(Window.partitionBy(key, "_span").orderBy(unique_id))
    return (
        cut.withColumn("_in_span", in_span)
        .join(before, [key, "_span"], "left")
        .withColumn(
            number_column, (F.coalesce("_before", F.lit(0)) + F.col("_in_span")).cast("bigint")
        )
        .drop("_span", "_in_span", "_before")
    )


def rank_rows(
    rows: DataFrame, order: Sequence[str | Column], number_column: str, group: Sequence[str] = ()
) -> DataFrame:
    """Number rows from 1 in ``order``, within ``group`` if given, as a window over all rows would.

    A window sorts a whole group in one task. Here the rows are dealt out by ranges of
    (group, order), every range is numbered by its own task, and the counts of a group's earlier
    ranges are added: a table of one row per group and range. The ranges are drawn from a sample,
    another one each time, so the dealt rows are stored once and everything is read from them.

    Null sorts as ``order`` says, first by default; null group values are one group. Rows that tie
    on all of ``order`` are numbered in any order and share a range: end ``order`` on a unique column.
    """
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    # A struct equals another with nulls in the same places, so null groups join too.
    key = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    dealt = rows.repartitionByRange(*group, *ordered).withColumns({"_range": F.spark_partition_id(), "_group": key})
    dealt = store_once(dealt, "ranges")
    part = ["_range", "_group"]
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(*part)
        .agg(F.count("*").alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    in_range = F.row_number().over(Window.partitionBy(*part).orderBy(*ordered))
    return (
        dealt.withColumn("_in_range", in_range)
        .join(before, part)
        .withColumn(number_column, (F.col("_before") + F.col("_in_range")).cast("bigint"))
        .drop(*part, "_in_range", "_before")
    )
