import datetime as dt

import pytest
from pyspark.sql import functions as F

from quizlake import schemas
from quizlake.operators import scoring, store
from quizlake.streaming import submissions as feed

T0 = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def quizzes(spark):
    rows = [(q, 7, 70, T0, None, "Easy") for q in (1, 2, 3)]
    return spark.createDataFrame(rows, schemas.QUIZZES)


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(10 * q + n, q, "Q", ["a", "b", "c", "d"], n, "") for q in (1, 2) for n in range(3)]
    return spark.createDataFrame(rows, schemas.QUESTIONS)


def form(submission_id, quiz_id, day, *choices, user_id=7):
    given = {10 * quiz_id + n: c for n, c in enumerate(choices)}
    return (submission_id, user_id, 70, quiz_id, T0 + dt.timedelta(days=day), given)


BATCHES = [
    [form(1, 1, 0, 0, 1, 2), form(2, 1, 0, 0, None, 2, user_id=8), form(3, 9, 0, 1, 1, 1)],
    [form(4, 1, 1, 0, 0, 0), form(5, 1, 2, 0, 1, 0), form(1, 1, 0, 0, 1, 2), form(6, 3, 2)],
    [form(7, 2, 3, 0, 1, 2), form(7, 2, 3, 0, 1, 2)],
]


def run(spark, tmp_path, quizzes, questions, upto=len(BATCHES)):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in BATCHES[:upto]:
        spark.createDataFrame(batch, schemas.SUBMISSION_EVENTS).coalesce(1).write.mode("append").parquet(source)
        events = feed.submission_stream(spark, source)
        progress = str(tmp_path / "progress")
        feed.start_scoring(events, lambda: (quizzes, questions), out, progress).awaitTermination()
    return out


def test_feed(spark, tmp_path, quizzes, questions, rows_of):
    out = run(spark, tmp_path, quizzes, questions)
    performance = spark.read.parquet(f"{out}/performance")
    assert rows_of(performance, "performance_id", "score", "total", "percentage") == [
        (1, 3, 3, 100.0),
        (4, 1, 3, 1 / 3 * 100),
        (5, 2, 3, 2 / 3 * 100),
        (6, 0, 0, 0.0),
        (7, 3, 3, 100.0),
    ]
    assert spark.read.parquet(f"{out}/received").count() == 7
    refused = {r["submission_id"]: r["reason"] for r in spark.read.parquet(f"{out}/refused").collect()}
    assert refused == {2: "Please answer all questions. Missing: 1", 3: "Quiz not found"}
    answers = feed.current_answers(spark.read.parquet(f"{out}/user_answers"))
    assert rows_of(answers) == [
        (7, 1, 10, 0, 1), (7, 1, 11, 1, 1), (7, 1, 12, 0, 0),
        (7, 2, 20, 0, 1), (7, 2, 21, 1, 1), (7, 2, 22, 2, 1),
    ]


def test_feed_equals_batch(spark, tmp_path, quizzes, questions, rows_of):
    out = run(spark, tmp_path, quizzes, questions)
    events = spark.createDataFrame(sum(BATCHES, []), schemas.SUBMISSION_EVENTS).dropDuplicates(["submission_id"])
    judged = feed.split_submissions(events, quizzes, questions).filter(F.col("reason").isNull())
    headers, choices = feed.submission_headers(judged.drop("reason")), feed.submission_choices(judged)
    batch = scoring.performance_rows(scoring.score_submissions(headers, choices, questions))
    assert rows_of(spark.read.parquet(f"{out}/performance").drop("batch")) == rows_of(batch)
    graded = scoring.user_answer_rows(scoring.grade_answers(headers, choices, questions))
    empty = graded.limit(0)
    replaced = store.replace_answers(empty, graded, headers)
    assert rows_of(feed.current_answers(spark.read.parquet(f"{out}/user_answers"))) == rows_of(replaced)


def test_replayed_batch_changes_nothing(spark, tmp_path, quizzes, questions, rows_of):
    out = run(spark, tmp_path, quizzes, questions)
    names = {n: ["*"] for n in ("performance", "user_answers", "refused")}
    names["received"] = ["submission_id", "batch"]
    before = {n: rows_of(spark.read.parquet(f"{out}/{n}"), *c) for n, c in names.items()}
    again = spark.createDataFrame(BATCHES[1], schemas.SUBMISSION_EVENTS)
    feed.process_batch(again, 1, quizzes, questions, out)
    assert {n: rows_of(spark.read.parquet(f"{out}/{n}"), *c) for n, c in names.items()} == before


def test_unanswered_as_wrong(spark, tmp_path, quizzes, questions, rows_of):
    out = str(tmp_path / "wrong")
    events = spark.createDataFrame(BATCHES[0], schemas.SUBMISSION_EVENTS)
    feed.process_batch(events, 0, quizzes, questions, out, on_missing="wrong")
    assert rows_of(spark.read.parquet(f"{out}/performance"), "performance_id", "score") == [(1, 3), (2, 2)]


def test_quizzes_saved_while_the_feed_runs_are_found(spark, tmp_path, quizzes, questions):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for form_row in (form(1, 1, 0, 0, 1, 2), form(2, 2, 0, 0, 1, 2)):
        rows = spark.createDataFrame([form_row], schemas.SUBMISSION_EVENTS)
        rows.coalesce(1).write.mode("append").parquet(source)
    known = []

    def read_quizzes():
        known.append(len(known) + 1)
        return quizzes.filter(F.col("quiz_id") <= known[-1]), questions

    events = feed.submission_stream(spark, source, files_per_batch=1)
    feed.start_scoring(events, read_quizzes, out, str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(f"{out}/performance").count() == 2
