"""Note files of any format as rows."""

from __future__ import annotations

import os
import re
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quizlake.functions.text import strip
from quizlake.operators.notes import RTF, TEXT, note_route

# A folder of the local file system, as Hadoop writes it.
_LOCAL = re.compile(r"(?:file:(?://)?)?(?P<folder>/(?!/).*)")
# The characters that Spark escapes in the name of a partition's folder.
_UNSAFE = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")
# How the name of a written file begins, and the bytes that a task reads before it hands them on.
_WRITTEN = "file_name="
_BATCH_BYTES = 4 << 20


@F.pandas_udf(StringType())
def _drop_bad_bytes(content: pd.Series) -> pd.Series:
    return content.map(lambda raw: None if raw is None else bytes(raw).decode("utf-8", "ignore"))


def decode_dropping_bad_bytes(content: Column) -> Column:
    """UTF-8 text of ``content`` without the bytes that are not UTF-8.

    Spark's decoders raise or substitute. Valid content, nearly all of it, is cast in the JVM;
    only invalid content is sent to Python.
    """
    as_text = content.cast("string")
    valid = F.is_valid_utf8(as_text)
    return F.when(content.isNull() | valid, as_text).otherwise(
        _drop_bad_bytes(F.when(~valid, content))
    )


def read_note_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every file below ``path``. Spark lists no file of zero bytes."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )


def _escaped(name: str | None) -> str:
    """A file's name as Spark writes it in the name of a partition's folder."""
    if not name:
        return "__HIVE_DEFAULT_PARTITION__"
    return _UNSAFE.sub(lambda found: f"%{ord(found.group()):02X}", name)


def _write_sorted(batches, folder: str):
    """Per task: every name's rows as one file, put in place when it is whole, so a task can run again."""
    context = TaskContext.get()
    folder = f"{folder}/task={context.partitionId():05d}"
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.unfinished-{context.taskAttemptId()}"
    name, file = None, None
    for batch in batches:
        for own, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = _escaped(own)
            if own != name:
                if file:
                    file.close()
                    os.replace(part, f"{folder}/{_WRITTEN}{name}")
                name, file = own, open(part, "wb")
            file.write((content or b"") + b"\n")
    if file:
        file.close()
        os.replace(part, f"{folder}/{_WRITTEN}{name}")
    yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["value"])


def write_files(rows: DataFrame, path: str) -> None:
    """Every row (file_name, content as bytes) as a file, whose path ends in ``file_name=<name>``.

    Content ends in a line feed, as the text writer ends a line; rows of one name share a file. Tasks write
    the files side by side, each in place. The number of tasks is fixed: files cost by their number, which
    AQE does not see. In a folder of the local file system, Hadoop starts several processes for every
    file's permissions, some 50 ms a file: there the tasks write files themselves. Elsewhere the text
    writer does, which gives every file a folder.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("file_name", "content").repartition(tasks, "file_name")
    local = _LOCAL.match(path)
    if local:
        named = dealt.select(F.col("file_name").cast("string"), F.col("content").cast("binary")).sortWithinPartitions("file_name")
        written = named.mapInArrow(partial(_write_sorted, folder=local["folder"]), "value string")
        written.write.mode("errorifexists").text(path)
        return
    (
        dealt.select("file_name", F.col("content").cast("string").alias("value"))
        .write.mode("errorifexists")
        .partitionBy("file_name")
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        .text(path)
    )


def _read_folders(batches, root: str, names: list[str]):
    """Per task: path and content of the files in the folders of the given places, a few megabytes a batch."""
    paths, contents, size = [], [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    for places in batches:
        for place in places.column(0).to_pylist():
            folder = f"{root}/{names[place]}"
            with os.scandir(folder) as entries:
                for entry in entries:
                    if not entry.name.startswith(_WRITTEN):
                        continue
                    with open(entry.path, "rb") as file:
                        content = file.read()
                    paths.append(f"file:{folder}/{entry.name}")
                    contents.append(content)
                    size += len(content) + len(entry.name)
                    if size >= _BATCH_BYTES:
                        yield batch()
                        paths, contents, size = [], [], 0
    yield batch()


def read_written_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files that ``write_files`` wrote, their path ending in the file's name.

    In a folder of the local file system, the tasks list and read the folders that tasks wrote: the driver
    knows these folders only. Elsewhere Spark's reader lists every file in the driver.
    """
    local = _LOCAL.match(path)
    if local:
        root = local["folder"].rstrip("/")
        names = sorted(name for name in os.listdir(root) if name.startswith("task="))
        # Of an RDD Spark knows no size: it does not take the files for as few bytes as the places.
        places = spark.createDataFrame(spark.sparkContext.parallelize([(i,) for i in range(len(names))], max(len(names), 1)), "place int")
        files = places.mapInArrow(partial(_read_folders, root=root, names=names), "path string, content binary")
    else:
        files = read_note_files(spark, path)
    return files.withColumn("path", F.regexp_replace("path", "/file_name=([^/]*)(/[^/]*)?$", "/$1"))


def with_empty_files(files: DataFrame, uploads: DataFrame) -> DataFrame:
    """``files`` plus an empty file for every path of the upload log that was not listed."""
    unlisted = uploads.select("path").join(files.select("path"), "path", "left_anti")
    return files.unionByName(unlisted.withColumn("content", F.unhex(F.lit(""))))


def notes_from_files(files: DataFrame) -> DataFrame:
    """path, file_name, route and what can be read here.

    Plain text becomes ``text``. RTF is decoded to ``markup`` for its extractor. The other
    routes keep their bytes in ``content``; extractors return parts for assemble_notes.
    """
    named = files.withColumn("file_name", F.regexp_extract("path", "[^/]*$", 0)).withColumn(
        "route", note_route(F.col("file_name"))
    )
    decodable = F.col("route").isin(TEXT, RTF)
    decoded = named.withColumn(
        "_decoded", decode_dropping_bad_bytes(F.when(decodable, F.col("content")))
    )
    return decoded.select(
        "path",
        "file_name",
        "route",
        F.when(F.col("route") == TEXT, strip(F.col("_decoded"))).alias("text"),
        F.when(F.col("route") == RTF, F.col("_decoded")).alias("markup"),
        F.when(~decodable, F.col("content")).alias("content"),
    )
