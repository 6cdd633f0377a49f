"""Repeated lines: levelled sorted runs of line hashes, fed batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm.columns import BLANKS, carried, lower_ascii, named, others_of, text_of
from quizlake.session import scratch_path, store_once

KEY = ["hash_1", "hash_2"]
# Lines that a bucket of all runs together may hold, as long as there are not too many buckets.
_BUCKET_LINES, _MOST_BUCKETS = 500_000, 100_000
_SMALLEST = -9_223_372_036_854_775_808


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Trust the order in which the one file of a bucket was written."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class LineRuns:
    """Line hashes in sorted runs, level by level.

    A run holds a row per line hash: in how many documents of its batches the line occurs,
    and the document that keeps it if the line was new then. Batches come in descending id,
    so the first document to bring a line is the largest holding it. When a level has
    ``fanout`` runs they are merged into one run of the next level, so ``n`` batches leave
    about ``fanout * log(n)`` runs and each row is rewritten ``log(n)`` times.

    Runs are tables bucketed and sorted by the hash, all into the same number of buckets, as is a batch
    once its lines are counted. So a batch is merged with every run, and runs with each other,
    bucket by bucket as they lie: nothing of a run is shuffled or sorted again.
    """

    spark: SparkSession
    fanout: int = 3
    buckets: int = 8
    levels: list[list[DataFrame]] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _table(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a bucketed and sorted table. Rows that come out of a merge lie in their buckets already."""
        path = scratch_path(self.spark, "line-run")
        table = f"line_run_{path.rsplit('-', 1)[-1]}"
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def merge(self, batch: DataFrame) -> DataFrame:
        """A counted batch beside all runs: a line that none of them holds is kept by its largest document."""
        known = F.lit(False)
        for number, run in enumerate(self.runs()):
            batch = batch.join(run.select(*KEY, F.lit(True).alias(f"in_{number}")), KEY, "left")
            known = known | F.col(f"in_{number}").isNotNull()
        return batch.select(*KEY, "n_docs", F.when(~known, F.col("largest")).alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (hash_1, hash_2, doc_id), all its ids below those of earlier batches."""
        counted = (
            batch.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(
                F.count("*").alias("n_docs"), F.max("doc_id").alias("largest")
            )
        )
        with sorted_buckets(self.spark):
            counted = self._table(counted.repartition(self.buckets, *KEY))
            merged = self.merge(counted)
            self._append(self._table(merged) if self.runs() else merged, 0)

    def _append(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._table(self.merged(self.levels[level]))
            self.levels[level] = []
            self._append(merged, level + 1)

    def merged(self, runs: list[DataFrame] | None = None) -> DataFrame:
        """One row per line hash over ``runs``, by default all of them; two at a time, each pair as it lies."""
        first, *others = self.runs() if runs is None else runs
        for number, run in enumerate(others, 1):
            other = run.select(*KEY, F.col("n_docs").alias("more"), F.col("keeper").alias("other"))
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            keeper = F.greatest("keeper", "other")  # of both, at most one is not null
            first = first.join(other, KEY, "full_outer").select(*KEY, n_docs.alias("n_docs"), keeper.alias("keeper"))
            if number < len(others):
                first = self._table(first)
        return first

    def forget(self) -> None:
        """Take the runs' names from the catalog; their files lie in the scratch folder."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.levels, self.tables = [], []


def _documents(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    raw = text_of(text)
    return docs.select(
        F.coalesce(named(doc_id).cast("long"), F.lit(_SMALLEST)).alias("id"),
        F.xxhash64(raw).alias("mark"),
        F.split(raw, "\n", -1).alias("lines"),
        *more,
    )


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40) -> DataFrame:
    """Every line whose key has ``min_chars`` code points: document, place and 128-bit key hash."""
    rows = _documents(docs, doc_id, text).select(
        F.col("id").alias("doc_id"), "mark", F.posexplode("lines").alias("place", "line")
    )
    keyed = rows.select("doc_id", "mark", "place", lower_ascii(F.btrim("line", F.lit(BLANKS))).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        "doc_id", "mark", "place", F.xxhash64("key").alias("hash_1"), F.xxhash64(F.lit("second"), "key").alias("hash_2")
    )


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fanout: int = 3,
    carry: bool = False,
) -> DataFrame:
    """``docs`` without its repeated lines, plus ``n_lines``, ``n_dropped`` and the new text.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that ``min_docs`` documents hold stay only in the document of
    the largest id; there all its copies stay. The columns added are ``kept_text``,
    ``n_lines`` (before) and ``n_dropped``; the others pass through, but for columns of these
    three names, which give way. With ``carry`` nothing gives way: a row has the three, its ``text``
    and its other columns in the struct ``others``.

    Null and empty texts are one empty line; texts of any length are split whole. A null id counts as
    the smallest. Rows of one id are one document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = store_once(line_rows(docs, doc_id, text, min_chars), "lines")
    cuts = _cuts(rows, batches)
    runs = LineRuns(spark, fanout, min(max(8, rows.count() // _BUCKET_LINES), _MOST_BUCKETS))
    for upper, lower in zip([None, *cuts], [*cuts, None]):
        batch = rows
        if upper is not None:
            batch = batch.filter(F.col("doc_id") <= upper)
        if lower is not None:
            batch = batch.filter(F.col("doc_id") > lower)
        runs.add(batch)
    # As a table of its own, so that the join below meets nothing but scans and a hot line can be cut.
    with sorted_buckets(spark):
        repeated = runs.merged().filter(F.col("n_docs") >= min_docs).select(*KEY, "keeper")
        repeated = store_once(repeated, "repeated-lines")
    runs.forget()
    dropped = (
        rows.join(repeated, KEY)
        .filter(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("id"), "mark")
        .agg(F.collect_set("place").alias("gone"))
    )
    whole = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.col("stays"), lambda place: F.get(F.col("lines"), place))
    out = (
        _documents(docs, doc_id, text, named(text).alias("text"), others_of(docs, text))
        .join(dropped, ["id", "mark"], "left")
        .withColumn("stays", F.when(F.col("gone").isNull(), whole).otherwise(F.array_except(whole, F.col("gone"))))
        .select(
            "text",
            "others",
            F.when(F.col("gone").isNull(), text_of("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("stays")).cast("long").alias("n_dropped"),
        )
    )
    if carry:
        return out
    added = ["kept_text", "n_lines", "n_dropped"]
    passed = [column for name, column in zip(docs.columns, carried(docs, text)) if name not in added]
    return out.select(*passed, *added)


def _cuts(rows: DataFrame, batches: int) -> list[int]:
    """Ids that split ``rows`` into ``batches`` of about equal size, descending."""
    shares = [1 - k / batches for k in range(1, batches)]
    found = rows.agg(F.percentile_approx("doc_id", shares).alias("cuts")).first()["cuts"] if shares else None
    return sorted(set(found or []), reverse=True)
