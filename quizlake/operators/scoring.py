"""Submitted choices against the answer key.

``submissions``  submission_id, user_id, module_id, quiz_id, submitted_at
``choices``      submission_id, quiz_id, question_id, choice (null or absent = unanswered)
``questions``    the questions table

Joins on quiz or question meet a hot quiz; both are followed by an exchange on
submission_id, so AQE splits the hot partition on the submission side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions.text import percent_text

# Fixed values.
UNANSWERED = -1
OPTIONS = 4


def percentage(score: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(score, total) * 100, F.lit(0.0))


def answer_counts(
    submissions: DataFrame, choices: DataFrame, questions: DataFrame
) -> DataFrame:
    """One row per submission: total, score and missing answers.

    total is the size of the quiz, not of the form. Only the choices meet the answer key; the
    submission x question product is never built, and only two counters per submission leave
    the join.
    """
    totals = questions.groupBy("quiz_id").agg(F.count("*").alias("total"))
    key = questions.select("quiz_id", "question_id", "correct_answer")
    marked = (
        choices.join(key, ["quiz_id", "question_id"])
        .groupBy("submission_id")
        .agg(
            F.sum((F.col("choice") == F.col("correct_answer")).cast("bigint")).alias("score"),
            F.count("choice").alias("answered"),
        )
    )
    return (
        submissions.join(totals, "quiz_id", "left")
        .join(marked, "submission_id", "left")
        .withColumns(
            {
                "total": F.coalesce("total", F.lit(0)),
                "score": F.coalesce("score", F.lit(0)),
                "answered": F.coalesce("answered", F.lit(0)),
            }
        )
        .withColumn("missing", F.col("total") - F.col("answered"))
        .drop("answered")
    )


def score_submissions(
    submissions: DataFrame,
    choices: DataFrame,
    questions: DataFrame,
    on_missing: str = "wrong",
) -> DataFrame:
    """Score every attempt. An open question counts as wrong, or rejects the form.

    ``on_missing="reject"`` is the interactive rule: a form with an open question is not scored.
    """
    if on_missing not in ("wrong", "reject"):
        raise ValueError("on_missing is 'wrong' or 'reject'")
    counted = answer_counts(submissions, choices, questions)
    if on_missing == "reject":
        counted = counted.filter(F.col("missing") == 0)
    return counted.drop("missing").withColumn(
        "percentage", percentage(F.col("score"), F.col("total"))
    )


def missing_answers(
    submissions: DataFrame, choices: DataFrame, questions: DataFrame
) -> DataFrame:
    """Open questions per submission and whether the form is accepted."""
    counted = answer_counts(submissions, choices, questions)
    return counted.select(
        "submission_id", "quiz_id", "total", "missing", (F.col("missing") == 0).alias("accepted")
    )


def performance_rows(scored: DataFrame) -> DataFrame:
    """The performance table's view of scored attempts; the attempt id breaks time ties."""
    return scored.select(
        F.col("submission_id").alias("performance_id"),
        "user_id",
        "module_id",
        F.col("submitted_at").alias("timestamp"),
        "score",
        "total",
        "percentage",
    )


def grade_answers(
    submissions: DataFrame, choices: DataFrame, questions: DataFrame
) -> DataFrame:
    """One row per submission and question of its quiz, with the verdict.

    Extra columns of ``questions`` are carried along.
    """
    asked = submissions.join(questions, "quiz_id")
    given = choices.select("submission_id", "question_id", "choice")
    chosen = F.coalesce("choice", F.lit(UNANSWERED)).cast("int")
    return (
        asked.join(given, ["submission_id", "question_id"], "left")
        .withColumn("user_answer", chosen)
        .withColumn("is_correct", (F.col("user_answer") == F.col("correct_answer")).cast("int"))
        .drop("choice")
    )


def user_answer_rows(graded: DataFrame) -> DataFrame:
    return graded.select(
        "submission_id",
        "submitted_at",
        "user_id",
        "quiz_id",
        "question_id",
        "user_answer",
        "is_correct",
    )


def review_lines(
    submissions: DataFrame, choices: DataFrame, numbered_questions: DataFrame
) -> DataFrame:
    """What a user reads after submitting: number, verdict, chosen and correct option text."""
    graded = grade_answers(submissions, choices, numbered_questions)
    correct = F.col("is_correct") == 1
    return graded.select(
        "submission_id",
        "question_id",
        F.col("question_number"),
        "question_text",
        F.when(correct, F.lit("Correct")).otherwise(F.lit("Incorrect")).alias("verdict"),
        F.get("options", F.col("user_answer")).alias("chosen_option"),
        F.get("options", F.col("correct_answer")).alias("correct_option"),
        F.when(F.col("explanation") != "", F.col("explanation")).alias("explanation"),
    )


def grade_band(percent: Column) -> Column:
    """Decided on the unrounded percentage."""
    # Fixed values.
    return (
        F.when(percent >= 90, "Outstanding!")
        .when(percent >= 75, "Great job!")
        .when(percent >= 60, "Good effort!")
        .otherwise("Keep practicing!")
    )


def result_lines(scored: DataFrame) -> DataFrame:
    score_of_total = F.concat(
        F.col("score").cast("string"), F.lit("/"), F.col("total").cast("string")
    )
    line = F.concat(
        F.col("band"),
        F.lit(" Your score: "),
        F.col("score_of_total"),
        F.lit(" ("),
        F.col("percent"),
        F.lit(")"),
    )
    return (
        scored.select(
            "submission_id",
            grade_band(F.col("percentage")).alias("band"),
            score_of_total.alias("score_of_total"),
            percent_text(F.col("percentage")).alias("percent"),
        ).withColumn("result_line", line)
    )


def question_difficulty(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Per question: answers given, share of them right, and the share of each option in list order.

    ``answers`` has question_id, user_answer and is_correct. One pass of conditional counts, added up
    before the shuffle, so no option becomes a row; a question nobody answered has null shares.
    An open question counts as answered wrong and as no option.
    """
    options = range(OPTIONS)
    counts = [F.count_if(F.col("user_answer") == option).alias(f"_option_{option}") for option in options]
    found = answers.groupBy("question_id").agg(
        F.count("*").alias("answers"), F.sum("is_correct").alias("_right"), *counts
    )
    share = lambda n: F.try_divide(n, F.col("answers"))
    return questions.select("question_id").join(found, "question_id", "left").select(
        "question_id",
        F.coalesce("answers", F.lit(0)).alias("answers"),
        share(F.col("_right")).alias("share_correct"),
        F.array(*[share(F.col(f"_option_{option}")) for option in options]).alias("option_shares"),
    )
