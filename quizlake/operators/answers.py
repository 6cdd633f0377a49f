"""Stored answers: the last submission per user and quiz, kept in a table that is rewritten by parts.

One rule says which submission is the last, in a batch, in the store and in the feed: the latest
``submitted_at``, then the largest submission_id. A form that arrives late changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.operators.keys import assign_ids
from quizlake.operators.store import latest_submissions
from quizlake.schemas import TABLES
from quizlake.session import store_once
from quizlake.sources.tables import committed_runs, path_exists, record_run

PARTS = 256
OWNER = ["user_id", "quiz_id"]

_TYPES = {f.name: f.dataType.simpleString() for f in TABLES["user_answers"]}
_STORED = ", ".join(f"{name} {kind}" for name, kind in _TYPES.items()) + (
    ", submission_id bigint, submitted_at timestamp_ntz, part int"
)


def _part(parts: int) -> Column:
    return F.pmod(F.hash(*OWNER), F.lit(parts))


def _read(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/user_answers"
    if not path_exists(spark, path):
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).parquet(path)


def read_answers(spark: SparkSession, root: str) -> DataFrame:
    """The typed user_answers table, with the submission that each answer comes from."""
    return _read(spark, root).filter(F.col("question_id").isNotNull()).drop("part")


def last_wins(stored: DataFrame, submissions: DataFrame) -> DataFrame:
    """The submissions of a batch that are later than what is stored for their user and quiz."""
    mark = F.struct("submitted_at", "submission_id")
    known = stored.groupBy(*OWNER).agg(F.max(mark).alias("_known"))
    newest = latest_submissions(submissions).select("submission_id", *OWNER, "submitted_at")
    return (
        newest.join(known, OWNER, "left")
        .filter(F.col("_known").isNull() | (mark > F.col("_known")))
        .drop("_known")
    )


def save_answers(
    answers: DataFrame, submissions: DataFrame, root: str, run_id: str, parts: int = PARTS
) -> None:
    """Let a batch's last submissions replace what is stored under ``root`` for their users and quizzes.

    ``answers`` are the graded answers of ``submissions`` (submission_id, user_id, quiz_id, submitted_at).
    The table is partitioned by a hash of (user_id, quiz_id): only the parts that the batch touches are
    read, and only they are rewritten, by a dynamic partition overwrite. New answers get ids above all
    that were ever given; the highest one is recorded with the run, so ids are not scanned for. A
    submission without answers is kept as a row without a question, which clears older answers.

    The new parts are staged first and recorded, then put in place: a save that ended in between is
    done again under the same ``run_id`` with the same rows, and one that was recorded as done is skipped.
    """
    spark = answers.sparkSession
    runs = committed_runs(spark, root, "answers")
    if run_id in runs:
        return
    staged = f"{root}/staged-answers/run={run_id}"
    if not path_exists(spark, f"{staged}/_SUCCESS"):
        _stage(answers, submissions, root, staged, max(runs.values(), default=0), parts)
    rows = spark.read.schema(_STORED).parquet(staged)
    (
        rows.repartition("part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(f"{root}/user_answers")
    )
    highest = rows.agg(F.max("answer_id")).first()[0]
    record_run(spark, root, "answers", run_id, max(highest or 0, *runs.values(), 0))


def _stage(answers: DataFrame, submissions: DataFrame, root: str, path: str, highest: int, parts: int) -> None:
    spark = answers.sparkSession
    batch = store_once(latest_submissions(submissions).withColumn("part", _part(parts)), "answer-batch")
    touched = [row.part for row in batch.select("part").distinct().collect()]  # at most ``parts`` numbers
    stored = _read(spark, root).filter(F.col("part").isin(touched))
    winners = store_once(last_wins(stored, batch), "answer-winners")
    kept = stored.join(winners, OWNER, "left_anti")
    given = answers.select("submission_id", "question_id", "user_answer", "is_correct")
    # Numbered rows are counted and then numbered; what can be made anew from a row stays out of the exchange.
    fresh = store_once(winners.drop("part").join(given, "submission_id", "left"), "answers-fresh")
    numbered = assign_ids(
        fresh.filter(F.col("question_id").isNotNull()),
        "answer_id",
        [*OWNER, "question_id"],
        existing=spark.range(highest, highest + 1).withColumnRenamed("id", "answer_id"),
    )
    cleared = fresh.filter(F.col("question_id").isNull()).withColumn("answer_id", F.lit(None).cast("bigint"))
    columns = [f.name for f in kept.schema]
    added = numbered.unionByName(cleared).withColumn("part", _part(parts))
    out = kept.unionByName(added.select(*columns))
    out.write.mode("overwrite").parquet(path)
