"""Typed Parquet tables: scan, parameterised SQL, append, replace, repeatable saves, bucketed tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.schemas import TABLES

# What a table is bucketed and sorted by: the key its readers join or look up by.
BUCKET_KEYS = {
    "users": ("user_id",),
    "modules": ("user_id", "module_id"),
    "quizzes": ("quiz_id",),
    "questions": ("quiz_id", "question_id"),
    "user_answers": ("quiz_id", "question_id"),
    "performance": ("user_id", "module_id"),
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one of the six tables with its declared types; columns and filters reach the scan."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in TABLES}


def query(
    spark: SparkSession, sql: str, params: dict[str, Any] | None = None, **frames: DataFrame
) -> DataFrame:
    """SQL text with named ``:parameters`` over DataFrames named in ``{braces}``."""
    return spark.sql(sql, args=params or {}, **frames)


def conform(rows: DataFrame, name: str) -> DataFrame:
    """The declared columns in order and type; columns the rows lack become null."""
    return rows.select(
        *[
            (F.col(field.name) if field.name in rows.columns else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in TABLES[name]
        ]
    )


def append_table(rows: DataFrame, root: str, name: str) -> None:
    conform(rows, name).write.mode("append").parquet(f"{root}/{name}")


def write_table(rows: DataFrame, root: str, name: str) -> None:
    """Write a whole table to a root that does not hold it yet; readers switch roots after."""
    conform(rows, name).write.mode("errorifexists").parquet(f"{root}/{name}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


# --- saves that can be repeated -------------------------------------------------------------


def committed_runs(spark: SparkSession, root: str, kind: str) -> dict[str, int]:
    """The runs recorded as done, with the highest id each gave: one row per save."""
    path = f"{root}/commits-{kind}"
    if not path_exists(spark, path):
        return {}
    rows = spark.read.schema("highest bigint, run string").parquet(path).collect()
    return {row.run: row.highest or 0 for row in rows}


def record_run(spark: SparkSession, root: str, kind: str, run_id: str, highest: int = 0) -> None:
    """Record a run as done. The record is one file, so it is there as a whole or not at all."""
    row = spark.range(1).select(F.lit(highest).cast("bigint").alias("highest"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/commits-{kind}/run={run_id}")


def commit_quizzes(headers: DataFrame, questions: DataFrame, root: str, run_id: str) -> None:
    """Save generated quizzes as run ``run_id``: both tables under the run's name, then its record.

    Readers take recorded runs only. A save that ended before its record left nothing that is
    seen; done again under the same name it overwrites exactly its own files, and a run that is
    recorded is not written twice.
    """
    spark = headers.sparkSession
    if run_id in committed_runs(spark, root, "quizzes"):
        return
    for name, rows in (("questions", questions), ("quizzes", headers)):
        conform(rows, name).write.mode("overwrite").parquet(f"{root}/{name}/run={run_id}")
    record_run(spark, root, "quizzes", run_id)


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """quizzes or questions of the recorded runs; the others' folders are not even listed."""
    runs = sorted(committed_runs(spark, root, "quizzes"))
    if not runs:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(*[f"{root}/{name}/run={run}" for run in runs])


# --- bucketed tables ------------------------------------------------------------------------


def save_bucketed(rows: DataFrame, name: str, table: str, path: str, buckets: int) -> DataFrame:
    """Write one of the six tables as ``table``, bucketed and sorted by its key, and scan it.

    A join on the key reads it without an exchange, a filter on the key reads only its buckets.
    """
    keys = BUCKET_KEYS[name]
    (
        conform(rows, name)
        .repartition(buckets, keys[0])
        .write.format("parquet")
        .mode("errorifexists")
        .bucketBy(buckets, keys[0])
        .sortBy(*keys)
        .option("path", path)
        .saveAsTable(table)
    )
    return rows.sparkSession.table(table)


def open_bucketed(spark: SparkSession, name: str, table: str, path: str, buckets: int) -> DataFrame:
    """Make a bucketed table that another session wrote known to this one, and scan it."""
    keys = BUCKET_KEYS[name]
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in TABLES[name])
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"CLUSTERED BY ({keys[0]}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def save_quizzes(headers: DataFrame, questions: DataFrame, root: str) -> None:
    """Append generated quizzes. Questions go first: a header is never visible without them."""
    append_table(questions, root, "questions")
    append_table(headers, root, "quizzes")


def export_json(files: DataFrame, path: str) -> None:
    """file_name and document per line; one object per quiz would be too many small files."""
    files.select("file_name", "document").write.mode("errorifexists").json(path)
