"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the library relies on. Skewed joins are split by AQE: every large
# equi-join in this package is followed by another exchange (or by the sink), so AQE is
# free to cut a hot partition of its probe side. A union of bucketed tables says that it lies
# by their buckets, which Spark 4.1 then reads as it does not: groups come out in pieces.
# Stored rows are compressed with zstd, about two thirds of the default's size.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session somebody else created."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quizlake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def limit_batches(spark: SparkSession, size: str = "4m") -> None:
    """Send rows to Python in batches of about ``size`` instead of 10,000 rows of any size.

    A batch exists several times over, in the executor's memory outside the heap and in the worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quizlake-"))
    return named or context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quizlake/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so a lost executor does not replay what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store_once(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return its scan.

    For a costly frame with several readers: it is computed once, readers see one set of
    rows, and each scans only the columns it needs.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """``store_once`` as a table in as many buckets of ``key`` as there are shuffle partitions.

    For readers that join or group by ``key``: they need no exchange of these rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key)
    dealt.option("path", path).saveAsTable(table)
    return spark.table(table)
