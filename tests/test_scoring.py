import datetime as dt

import pytest
from pyspark.sql import functions as F

from quizlake import schemas
from quizlake.operators import catalog, progress, scoring
from quizlake.plans import journeys
from tests.plans import count, final_plan

T0 = dt.datetime(2024, 5, 1, 9, 30, 15)
SUBMISSIONS = "submission_id bigint, user_id bigint, module_id bigint, quiz_id bigint, submitted_at timestamp_ntz"
CHOICES = "submission_id bigint, quiz_id bigint, question_id bigint, choice int"


def question(number, quiz, answer, explanation="why"):
    return (number, quiz, f"Q{number}", ["a", "b", "c", "d"], answer, explanation)


@pytest.fixture(scope="module")
def small(spark):
    questions = [question(100 + n, 1, n % 4) for n in range(16)]
    questions += [question(200 + n, 2, 1, None if n else "") for n in range(9)]
    submissions = [(10, 7, 70, 1, T0), (11, 7, 70, 2, T0), (12, 8, 80, 3, T0), (13, 7, 70, 2, T0)]
    choices = [(10, 1, 100, 0)] + [(10, 1, 100 + n, (n + 1) % 4) for n in range(1, 16)]
    choices += [(11, 2, 200 + n, 1 if n < 7 else 0) for n in range(9)]
    # An open question, a null choice, a question of another quiz.
    choices += [(13, 2, 200, 1), (13, 2, 201, None), (13, 2, 100, 0)]
    return (
        spark.createDataFrame(submissions, SUBMISSIONS),
        spark.createDataFrame(choices, CHOICES),
        spark.createDataFrame(questions, schemas.QUESTIONS),
    )


def test_scores(small, rows_of):
    scored = scoring.score_submissions(*small)
    assert rows_of(scored, "submission_id", "score", "total", "percentage") == [
        (10, 1, 16, 6.25),
        (11, 7, 9, 7 / 9 * 100),
        (12, 0, 0, 0.0),
        (13, 1, 9, 1 / 9 * 100),
    ]


def test_incomplete_forms_are_rejected(small, rows_of):
    scored = scoring.score_submissions(*small, on_missing="reject")
    assert rows_of(scored, "submission_id") == [(10,), (11,), (12,)]
    assert rows_of(scoring.missing_answers(*small), "submission_id", "missing", "accepted") == [
        (10, 0, True),
        (11, 0, True),
        (12, 0, True),
        (13, 8, False),
    ]
    with pytest.raises(ValueError):
        scoring.score_submissions(*small, on_missing="?")


def test_result_lines(small):
    lines = {r["submission_id"]: r for r in scoring.result_lines(scoring.score_submissions(*small)).collect()}
    assert lines[10]["percent"] == "6.2%" and lines[10]["score_of_total"] == "1/16"
    assert lines[11]["result_line"] == "Great job! Your score: 7/9 (77.8%)"
    assert lines[12]["result_line"] == "Keep practicing! Your score: 0/0 (0.0%)"


def test_bands(spark):
    values = {90.0: "Outstanding!", 89.999: "Great job!", 75.0: "Great job!", 74.99: "Good effort!",
              60.0: "Good effort!", 59.999: "Keep practicing!", 0.0: "Keep practicing!"}
    frame = spark.createDataFrame([(v,) for v in values], "p double")
    got = frame.select("p", scoring.grade_band(F.col("p")).alias("b")).collect()
    assert {r["p"]: r["b"] for r in got} == values


def test_grading_matches_scoring(small):
    graded = scoring.grade_answers(*small)
    sums = graded.groupBy("submission_id").agg(F.sum("is_correct").alias("s"), F.count("*").alias("n"))
    by_id = {r["submission_id"]: (r["s"], r["n"]) for r in sums.collect()}
    for row in scoring.score_submissions(*small).collect():
        assert by_id.get(row["submission_id"], (0, 0)) == (row["score"], row["total"])
        assert 0 <= row["score"] <= row["total"]
    open_answer = graded.filter("submission_id = 13 and question_id = 201").collect()[0]
    assert (open_answer["user_answer"], open_answer["is_correct"]) == (-1, 0)


def test_review(small):
    submissions, choices, questions = small
    review = scoring.review_lines(submissions, choices, catalog.number_questions(questions))
    rows = {(r["submission_id"], r["question_number"]): r for r in review.collect()}
    assert rows[10, 1]["verdict"] == "Correct" and rows[10, 1]["chosen_option"] == "a"
    second = rows[10, 2]
    assert (second["verdict"], second["chosen_option"], second["correct_option"]) == ("Incorrect", "c", "b")
    assert rows[13, 2]["chosen_option"] is None
    assert rows[11, 1]["explanation"] is None and rows[11, 2]["explanation"] is None
    assert rows[10, 16]["explanation"] == "why"


def test_a_quiz_with_a_third_of_all_submissions_is_split(spark, sql_settings):
    """AQE cuts the hot partition in both joins; nothing is lost."""
    sql_settings(
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20000",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20000",
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )
    n = 60_000
    quiz = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1)
    submissions = spark.range(0, n, 1, 8).select(
        F.col("id").alias("submission_id"),
        F.col("id").alias("user_id"),
        F.lit(1).cast("bigint").alias("module_id"),
        quiz.cast("bigint").alias("quiz_id"),
        F.lit(T0).cast("timestamp_ntz").alias("submitted_at"),
    )
    choices = submissions.select(
        "submission_id", "quiz_id", (F.col("quiz_id") * 10).alias("question_id"), F.lit(1).alias("choice")
    )
    questions = spark.range(5001).select(
        (F.col("id") * 10).alias("question_id"),
        F.col("id").alias("quiz_id"),
        F.lit("q").alias("question_text"),
        F.array(*[F.lit(x) for x in "abcd"]).alias("options"),
        F.lit(1).alias("correct_answer"),
        F.lit("").alias("explanation"),
    )
    scored = scoring.score_submissions(submissions, choices, questions)
    assert "skew=true" in final_plan(scored)
    assert scored.filter("score = 1 and total = 1").count() == n
    graded = scoring.grade_answers(submissions, choices, questions)
    assert "skew=true" in final_plan(graded)
    assert graded.filter("is_correct = 1").count() == n


def test_scoring_never_builds_the_form(small):
    plan = final_plan(scoring.score_submissions(*small))
    assert count(plan, "CartesianProduct") == count(plan, "BroadcastNestedLoopJoin") == 0
    assert "Python" not in plan


def test_progress(spark):
    rows = [
        (3, 1, 1, T0, 1, 3, 1 / 3 * 100),
        (2, 1, 1, T0, 3, 4, 75.0),
        (1, 1, 1, T0 + dt.timedelta(days=1), 4, 4, 100.0),
        (4, 1, 2, T0, 0, 5, 0.0),
    ]
    performance = spark.createDataFrame(rows, schemas.PERFORMANCE)
    shown = journeys.show_progress(performance)
    summary = {r["module_id"]: r for r in shown.summary.collect()}
    assert (summary[1]["attempts"], summary[1]["best"]) == (3, 100.0)
    assert summary[1]["average"] == pytest.approx((1 / 3 * 100 + 175) / 3)
    tiles = {r["module_id"]: r for r in progress.progress_metrics(shown.summary).collect()}
    assert (tiles[1]["average_score"], tiles[2]["best_score"]) == ("69.4%", "0.0%")
    assert [r["performance_id"] for r in shown.trend.collect()] == [2, 3, 1, 4]
    assert shown.history.columns[2:] == ["performance_id", "Date & Time", "Score", "Total", "Percentage (%)"]
    assert {r["Date & Time"] for r in shown.history.collect()} == {"2024-05-01 09:30", "2024-05-02 09:30"}


def test_taking_quizzes_end_to_end(small):
    taken = journeys.take_quizzes(*small)
    assert taken.performance.count() == 3
    assert taken.user_answers.count() == 25
    assert taken.review.count() == 25
    assert taken.results.count() == 3
