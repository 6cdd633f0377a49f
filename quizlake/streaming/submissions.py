"""The submission feed: files of submitted forms -> scored attempts and stored answers.

Each micro-batch writes its own folders, ``batch=<id>`` under ``received`` (every new form),
``refused`` (with the reason), ``user_answers`` and ``performance``. A replayed batch
overwrites exactly its own folders, so a restart after a loss at any point leaves the same
tables. Old answers are not rewritten: current_answers keeps the last submission per user and
quiz when reading.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from quizlake.operators.scoring import (
    grade_answers,
    missing_answers,
    performance_rows,
    score_submissions,
    user_answer_rows,
)
from quizlake.operators.store import latest_submissions
from quizlake.schemas import SUBMISSION_EVENTS

# Why a form is refused.
UNKNOWN_QUIZ = "Quiz not found"
INCOMPLETE = "Please answer all questions. Missing: "


def submission_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(SUBMISSION_EVENTS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def submission_headers(events: DataFrame) -> DataFrame:
    return events.drop("choices")


def submission_choices(events: DataFrame) -> DataFrame:
    return events.select(
        "submission_id", "quiz_id", F.explode("choices").alias("question_id", "choice")
    )


def split_submissions(
    events: DataFrame, quizzes: DataFrame, questions: DataFrame, on_missing: str = "reject"
) -> DataFrame:
    """Events with a ``reason`` column: null for those to be scored."""
    known = quizzes.select("quiz_id", F.lit(True).alias("_known"))
    counted = missing_answers(
        submission_headers(events), submission_choices(events), questions
    ).select("submission_id", "missing")
    reason = F.when(F.col("_known").isNull(), UNKNOWN_QUIZ)
    if on_missing == "reject":
        reason = reason.when(
            F.col("missing") > 0, F.concat(F.lit(INCOMPLETE), F.col("missing").cast("string"))
        )
    return (
        events.join(known, "quiz_id", "left")
        .join(counted, "submission_id", "left")
        .withColumn("reason", reason)
        .drop("_known", "missing")
    )


def _scored_before(events: DataFrame, out: str, batch_id: int) -> DataFrame | None:
    """submission_id of the batch's events that another batch has scored, None if none has.

    Ids grow with time, so the id range of the batch, pushed to the scan, skips almost all of
    the history; what is left is reduced by the batch's ids, the side Spark ships if it
    measures it small.
    """
    spark = events.sparkSession
    try:
        stored = spark.read.parquet(f"{out}/performance").filter(F.col("batch") != batch_id)
    except AnalysisException:  # nothing written yet
        return None
    low, high = events.agg(F.min("submission_id"), F.max("submission_id")).first()
    return (
        stored.filter(F.col("performance_id").between(low, high))
        .select(F.col("performance_id").alias("submission_id"))
        .join(events.select("submission_id"), "submission_id", "left_semi")
    )


def _new_events(events: DataFrame, out: str, batch_id: int) -> DataFrame:
    """One event per submission_id, without those already scored."""
    once = events.dropDuplicates(["submission_id"])
    seen = _scored_before(events, out, batch_id)
    return once if seen is None else once.join(seen, "submission_id", "left_anti")


# So many quizzes of a batch at most are named one by one in the filter of a scan.
NAMED_QUIZZES = 1000


def _of_quizzes(table: DataFrame, received: DataFrame) -> DataFrame:
    """The rows of ``table`` for the quizzes of a batch.

    A few quizzes are named in the filter, so that a table bucketed by quiz_id reads only their
    buckets. Of many the range reaches the scan, and the join needs no exchange on the side of a
    bucketed table; the batch, a stored table of known size, is the side to ship.
    """
    wanted = received.select("quiz_id").distinct()
    low, high, n = wanted.agg(F.min("quiz_id"), F.max("quiz_id"), F.count("quiz_id")).first()
    if n <= NAMED_QUIZZES:
        return table.filter(F.col("quiz_id").isin([row.quiz_id for row in wanted.dropna().collect()]))
    return table.filter(F.col("quiz_id").between(low, high)).join(wanted, "quiz_id", "left_semi")


def process_batch(
    events: DataFrame,
    batch_id: int,
    quizzes: DataFrame,
    questions: DataFrame,
    out: str,
    on_missing: str = "reject",
) -> None:
    """Score one micro-batch with the batch operators and write its folders.

    The new forms are stored first and read back, so all tables come from the same rows
    whatever is recomputed. performance is written last: it records what has been scored.
    """
    spark = events.sparkSession

    def write(rows: DataFrame, name: str) -> str:
        path = f"{out}/{name}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return path

    stored = write(_new_events(events, out, batch_id), "received")
    received = spark.read.schema(SUBMISSION_EVENTS).parquet(stored)
    quizzes, questions = _of_quizzes(quizzes, received), _of_quizzes(questions, received)
    judged = split_submissions(received, quizzes, questions, on_missing)
    refused = judged.filter(F.col("reason").isNotNull())
    accepted = judged.filter(F.col("reason").isNull()).drop("reason")
    headers, choices = submission_headers(accepted), submission_choices(accepted)
    write(refused.select("submission_id", "quiz_id", "reason"), "refused")
    write(user_answer_rows(grade_answers(headers, choices, questions)), "user_answers")
    write(performance_rows(score_submissions(headers, choices, questions)), "performance")


def start_scoring(
    events: DataFrame,
    read_quizzes: Callable[[], tuple[DataFrame, DataFrame]],
    out: str,
    checkpoint: str,
    on_missing: str = "reject",
    **trigger,
) -> StreamingQuery:
    """Run the feed into ``out``; by default until what is there now has been processed.

    ``read_quizzes`` returns the quizzes and questions tables. It is called for every batch, so
    quizzes saved while the feed runs are found.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        quizzes, questions = read_quizzes()
        process_batch(batch, batch_id, quizzes, questions, out, on_missing)

    return (
        events.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_answers(answer_log: DataFrame) -> DataFrame:
    """user_answers as of now: the answers of the last submission per user and quiz."""
    headers = answer_log.select("submission_id", "user_id", "quiz_id", "submitted_at").distinct()
    last = latest_submissions(headers).select("submission_id")
    return answer_log.join(last, "submission_id", "left_semi").select(
        "user_id", "quiz_id", "question_id", "user_answer", "is_correct"
    )
