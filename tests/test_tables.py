"""Saves that can be repeated, and bucketed tables."""

import pytest
from pyspark.sql import functions as F

from quizlake import schemas
from quizlake.operators import catalog, scoring
from quizlake.plans.derived import QuizData
from quizlake.plans.journeys import quizzes_from_responses
from quizlake.sources import tables
from quizlake.streaming import submissions as feed
from tests.plans import initial_plan
from tests.test_store import NOW, quiz_json

SMALL = "/root/testdata/sf0.001"
REQUESTS = "request_id bigint, user_id bigint, module_id bigint, notes_hash string, difficulty string"


def generated(spark, root, *texts):
    raw = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], schemas.RESPONSES)
    requests = spark.createDataFrame([(k, 7, 70, "hash", "Easy") for k in range(len(texts))], REQUESTS)
    return quizzes_from_responses(raw, requests, NOW, *(tables.read_committed(spark, root, n) for n in ("quizzes", "questions")))


def stored_texts(spark, root):
    documents = catalog.quiz_documents(*(tables.read_committed(spark, root, n) for n in ("quizzes", "questions")))
    return sorted([q["question"] for q in d["questions"]] for d in documents.collect())


def test_a_save_ends_between_its_two_tables_and_is_done_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert stored_texts(spark, root) == []
    new = generated(spark, root, quiz_json("a", "b"))
    tables.commit_quizzes(new.quizzes, new.questions, root, "one")
    lost = generated(spark, root, quiz_json("c"), quiz_json())
    write = tables.conform

    def ends_before_headers(rows, name):
        if name == "quizzes":
            raise RuntimeError("lost")
        return write(rows, name)

    with monkeypatch.context() as patch:
        patch.setattr(tables, "conform", ends_before_headers)
        with pytest.raises(RuntimeError):
            tables.commit_quizzes(lost.quizzes, lost.questions, root, "two")
    assert stored_texts(spark, root) == [["a", "b"]]
    again = generated(spark, root, quiz_json("c"), quiz_json())
    for _ in range(2):  # the second call finds the run recorded
        tables.commit_quizzes(again.quizzes, again.questions, root, "two")
        assert stored_texts(spark, root) == [[], ["a", "b"], ["c"]]
    questions = tables.read_committed(spark, root, "questions")
    assert questions.schema == schemas.QUESTIONS
    assert sorted(r.question_id for r in questions.collect()) == [1, 2, 3]
    assert sorted(r.quiz_id for r in tables.read_committed(spark, root, "quizzes").collect()) == [1, 2, 3]


@pytest.fixture
def bucketed(spark, tmp_path):
    data = QuizData(spark, SMALL)
    names = {n: f"{n}_{abs(hash(str(tmp_path)))}" for n in ("questions", "quizzes")}
    frames = {n: getattr(data, n)() for n in names}
    out = {n: tables.save_bucketed(frames[n], n, names[n], str(tmp_path / n), 8) for n in names}
    yield data, out, names
    for table in names.values():
        spark.sql(f"DROP TABLE {table}")


def files_read(frame):
    """With files too dear to share a task, the tasks of a scan are its files."""
    return frame.rdd.getNumPartitions()


def test_a_lookup_reads_the_buckets_of_its_keys(spark, bucketed, tmp_path, sql_settings):
    _, stored, names = bucketed
    sql_settings(spark__sql__files__openCostInBytes="128m")
    questions = stored["questions"]
    quiz = questions.select("quiz_id").first()[0]
    assert files_read(questions.select("quiz_id")) == 8
    assert files_read(questions.filter(F.col("quiz_id") == quiz)) == 1
    forms = spark.createDataFrame([(1, quiz), (2, quiz + 10**9), (3, None)], "submission_id bigint, quiz_id bigint")
    assert files_read(feed._of_quizzes(questions, forms)) <= 2
    assert feed._of_quizzes(questions, forms).count() == questions.filter(F.col("quiz_id") == quiz).count()
    # Another session, which has only the files, opens them as the same table.
    spark.sql(f"DROP TABLE {names['questions']}")
    opened = tables.open_bucketed(spark, "questions", names["questions"], str(tmp_path / "questions"), 8)
    assert opened.schema == schemas.QUESTIONS
    assert files_read(opened.filter(F.col("quiz_id") == quiz)) == 1
    assert opened.filter(F.col("quiz_id") == quiz).count() > 0


def test_joins_on_the_key_move_no_stored_rows(bucketed, sql_settings, rows_of):
    data, stored, _ = bucketed
    sql_settings(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = initial_plan(stored["quizzes"].join(stored["questions"], "quiz_id"))
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    scored = scoring.score_submissions(data.submissions(), data.choices(), stored["questions"])
    plan = initial_plan(scored)
    # Totals per quiz are counted where the bucket lies, without an exchange.
    totals = plan[plan.index("count(1)") :]
    assert "Exchange" not in totals[: totals.index("FileScan")]
    assert rows_of(scored) == rows_of(scoring.score_submissions(data.submissions(), data.choices(), data.questions()))


def test_unions_of_bucketed_tables_are_grouped_right(bucketed):
    _, stored, _ = bucketed
    n = stored["quizzes"].count()
    both = stored["quizzes"].select("quiz_id").unionByName(stored["quizzes"].select("quiz_id"))
    assert both.groupBy("quiz_id").count().filter("count = 2").count() == n
