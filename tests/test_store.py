import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quizlake import schemas
from quizlake.operators import catalog, responses, scoring, store
from quizlake.plans.journeys import quizzes_from_responses
from quizlake.sources import note_files, tables
from tests.plans import initial_plan

NOW = "2024-05-01T09:30:15"
T0 = dt.datetime(2024, 5, 1)


def test_modules_are_opened_or_created(spark):
    modules = spark.createDataFrame([(3, 1, "Bio", T0), (9, 2, "Bio", T0)], schemas.MODULES)
    asked = [(1, 1, " Bio\n"), (2, 1, "bio"), (3, 1, "New"), (4, 1, "New "), (5, 2, "New"), (6, 1, " "), (7, 1, None)]
    requests = spark.createDataFrame(asked, "request_id bigint, user_id bigint, module_name string")
    got = {r["request_id"]: r for r in store.get_or_create_modules(requests, modules, NOW).collect()}
    assert len(got) == len(asked)
    assert got[1]["module_id"] == 3 and not got[1]["created"]
    assert got[3]["module_id"] == got[4]["module_id"] != got[5]["module_id"]
    assert got[6]["module_id"] is None and got[7]["module_id"] is None
    created = store.new_modules(requests, modules, NOW)
    assert sorted(r["module_id"] for r in created.collect()) == [10, 11, 12]
    assert {r["created_at"] for r in created.collect()} == {dt.datetime.fromisoformat(NOW)}
    after = modules.unionByName(created)
    assert after.groupBy("user_id", "module_name").count().filter("count > 1").count() == 0
    assert store.new_modules(requests, after, NOW).count() == 0


def quiz_json(*questions):
    items = [{"question": q, "options": ["a", "b", "c", "d"], "answer": 1} for q in questions]
    return json.dumps({"questions": items})


@pytest.fixture
def saved(spark, tmp_path):
    raw = spark.createDataFrame(
        [(1, 1, quiz_json("z", "a", "m")), (2, 1, "no"), (2, 2, quiz_json("only")), (3, 1, "no"), (4, 1, quiz_json())],
        schemas.RESPONSES,
    )
    requests = spark.createDataFrame(
        [(i, 7, 70, "hash", "Easy") for i in range(1, 5)],
        "request_id bigint, user_id bigint, module_id bigint, notes_hash string, difficulty string",
    )
    root = str(tmp_path / "store")
    new = quizzes_from_responses(raw, requests, NOW)
    tables.save_quizzes(new.quizzes, new.questions, root)
    return root, raw, requests


def test_saved_quizzes_load_as_generated(spark, saved):
    root, raw, _ = saved
    quizzes, questions = tables.read_table(spark, root, "quizzes"), tables.read_table(spark, root, "questions")
    assert quizzes.schema == schemas.QUIZZES and questions.schema == schemas.QUESTIONS
    documents = catalog.quiz_documents(quizzes, questions).collect()
    texts = sorted([q["question"] for q in d["questions"]] for d in documents)
    assert texts == [[], ["only"], ["z", "a", "m"]]
    assert {q["explanation"] for d in documents for q in d["questions"]} == {""}
    one = documents[0]["quiz_id"]
    assert catalog.load_quiz(quizzes, questions, one).count() == 1
    assert catalog.load_quiz(quizzes, questions, 12345).count() == 0


def test_second_save_continues_the_ids(spark, saved):
    root, raw, requests = saved
    before = {name: tables.read_table(spark, root, name) for name in ("quizzes", "questions")}
    new = quizzes_from_responses(raw, requests, NOW, before["quizzes"], before["questions"])
    tables.save_quizzes(new.quizzes, new.questions, root)
    quizzes, questions = tables.read_table(spark, root, "quizzes"), tables.read_table(spark, root, "questions")
    assert sorted(r["quiz_id"] for r in quizzes.collect()) == list(range(1, 7))
    assert sorted(r["question_id"] for r in questions.collect()) == list(range(1, 9))
    frames = {n: spark.createDataFrame([], t) for n, t in schemas.TABLES.items()}
    frames |= {"quizzes": quizzes, "questions": questions}
    frames["users"] = spark.createDataFrame([(7, "a", "a@x.org", None, None, T0, 1)], schemas.USERS)
    frames["modules"] = spark.createDataFrame([(70, 7, "m", T0)], schemas.MODULES)
    assert store.audit_foreign_keys(frames).count() == 0


def test_a_failed_save_mixes_no_quizzes(spark, saved):
    """Questions written, headers not: the next save takes ids above both tables."""
    root, raw, requests = saved
    lost = quizzes_from_responses(
        raw, requests, NOW, *(tables.read_table(spark, root, n) for n in ("quizzes", "questions"))
    )
    tables.append_table(lost.questions, root, "questions")
    before = [tables.read_table(spark, root, n) for n in ("quizzes", "questions")]
    new = quizzes_from_responses(raw, requests, NOW, *before)
    tables.save_quizzes(new.quizzes, new.questions, root)
    documents = catalog.quiz_documents(*(tables.read_table(spark, root, n) for n in ("quizzes", "questions")))
    texts = sorted([q["question"] for q in d["questions"]] for d in documents.collect())
    assert texts == [[], [], ["only"], ["only"], ["z", "a", "m"], ["z", "a", "m"]]


def test_lists_and_defaults(spark):
    quizzes = spark.createDataFrame(
        [(i, 1, 1, T0, None, "Easy") for i in range(1, 61)] + [(99, 1, 2, T0, None, "Hard")], schemas.QUIZZES
    )
    newest = [r["quiz_id"] for r in catalog.quiz_list(quizzes, 1, 1).collect()]
    assert newest == list(range(60, 10, -1))
    assert catalog.latest_quizzes(quizzes).count() == 51
    for selected, opened in ((30, 30), (5, 60), (99, 60), (None, 60)):
        picks = spark.createDataFrame([(1, 1, selected)], "user_id bigint, module_id bigint, selected_quiz_id bigint")
        got = {r["module_id"]: r["quiz_id"] for r in catalog.default_quizzes(quizzes, picks).collect()}
        assert got == {1: opened, 2: 99}
    label = catalog.quiz_labels(quizzes).filter("quiz_id = 99").collect()[0]["label"]
    assert label == "Quiz #99 • 2024-05-01T00:00:00 • Hard"
    modules = spark.createDataFrame([(i, 1, n, T0) for i, n in enumerate("bBaÉZ")], schemas.MODULES)
    assert [r["module_name"] for r in catalog.module_list(modules, 1).collect()] == ["B", "Z", "a", "b", "É"]
    assert catalog.modules_per_user(modules, 2).count() == 2


def attempt(spark, submission_id, user_id, quiz_id, day, choice):
    header = spark.createDataFrame(
        [(submission_id, user_id, 1, quiz_id, T0 + dt.timedelta(days=day))],
        "submission_id bigint, user_id bigint, module_id bigint, quiz_id bigint, submitted_at timestamp_ntz",
    )
    choices = spark.createDataFrame(
        [(submission_id, quiz_id, 10 * quiz_id, choice)],
        "submission_id bigint, quiz_id bigint, question_id bigint, choice int",
    )
    return header, choices


def test_replacing_answers(spark, rows_of):
    questions = spark.createDataFrame(
        [(10 * q, q, "Q", ["a", "b", "c", "d"], 0, "") for q in (1, 2)], schemas.QUESTIONS
    )

    def graded(*attempts):
        headers = [h for h, _ in attempts]
        choices = [c for _, c in attempts]
        for more in headers[1:]:
            headers[0] = headers[0].unionByName(more)
        for more in choices[1:]:
            choices[0] = choices[0].unionByName(more)
        return headers[0], scoring.user_answer_rows(scoring.grade_answers(headers[0], choices[0], questions))

    _, stored = graded(attempt(spark, 1, 7, 1, 0, 0), attempt(spark, 2, 7, 2, 0, 0), attempt(spark, 3, 8, 1, 0, 0))
    headers, batch = graded(attempt(spark, 5, 7, 1, 2, 2), attempt(spark, 4, 7, 1, 1, 1), attempt(spark, 6, 7, 1, 2, 3))
    after = store.replace_answers(stored, batch, headers)
    expected = [(7, 1, 10, 3, 0), (7, 2, 20, 0, 1), (8, 1, 10, 0, 1)]
    assert rows_of(after) == expected
    again = store.replace_answers(after.withColumn("submission_id", F.lit(0)), batch, headers)
    assert rows_of(again) == expected


def test_latest_submission_is_picked_before_the_shuffle(spark):
    submissions = spark.range(1000).select(
        F.col("id").alias("submission_id"),
        (F.col("id") % 1).alias("user_id"),
        (F.col("id") % 1).alias("quiz_id"),
        F.lit(T0).cast("timestamp_ntz").alias("submitted_at"),
    )
    last = store.latest_submissions(submissions)
    assert [r["submission_id"] for r in last.collect()] == [999]
    plan = initial_plan(last)
    assert plan.index("Exchange") < plan.index("Partial")


def test_foreign_keys(spark):
    frames = {
        "users": [(1, "a", "a@x.org", None, None, T0, 1)],
        "modules": [(1, 1, "m", T0), (2, None, "n", T0), (3, 5, "o", T0)],
        "quizzes": [(1, 1, 1, T0, None, "Easy"), (2, 9, 8, T0, None, "Easy")],
        "questions": [(1, 1, "q", ["a"], 0, ""), (2, 3, "q", ["a"], 0, "")],
        "user_answers": [(1, 1, 1, 1, 0, 1), (2, 2, 4, 5, 0, 1)],
        "performance": [(1, 1, 1, T0, 0, 0, 0.0), (2, 2, 7, T0, 0, 0, 0.0)],
    }
    built = {n: spark.createDataFrame(rows, schemas.TABLES[n]) for n, rows in frames.items()}
    orphans = {(r["fk"], r["child_id"], r["missing_key"]) for r in store.audit_foreign_keys(built).collect()}
    assert orphans == {
        ("modules.user_id", 3, 5),
        ("quizzes.user_id", 2, 9),
        ("quizzes.module_id", 2, 8),
        ("questions.quiz_id", 2, 3),
        ("user_answers.user_id", 2, 2),
        ("user_answers.quiz_id", 2, 4),
        ("user_answers.question_id", 2, 5),
        ("performance.user_id", 2, 2),
        ("performance.module_id", 2, 7),
    }


def test_table_writes_and_parameters(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 7, 70, T0, 1, 2, 50.0), (2, 8, 70, T0, 2, 2, 100.0)], schemas.PERFORMANCE)
    tables.append_table(rows, root, "performance")
    tables.append_table(rows.limit(1), root, "performance")
    back = tables.read_table(spark, root, "performance")
    assert back.count() == 3 and back.schema == schemas.PERFORMANCE
    picked = tables.query(
        spark,
        "SELECT score, total FROM {performance} WHERE user_id = :user_id AND module_id = :module_id",
        {"user_id": 8, "module_id": 70},
        performance=back,
    )
    assert [tuple(r) for r in picked.collect()] == [(2, 2)]
    with pytest.raises(AnalysisException):
        tables.write_table(rows, root, "performance")


def test_export_files(spark, tmp_path):
    raw = spark.createDataFrame([(1, 1, quiz_json("é"))], schemas.RESPONSES)
    headers = spark.createDataFrame([(1, 42)], "request_id bigint, quiz_id bigint")
    documents = responses.export_documents(responses.curated_quizzes(raw))
    tables.export_json(responses.export_files(documents, headers), str(tmp_path / "out"))
    line = spark.read.json(str(tmp_path / "out")).collect()[0]
    assert line["file_name"] == "quiz_42.json"
    assert json.loads(line["document"])["questions"][0]["question"] == "é"


def test_one_indented_file_a_quiz(spark, tmp_path):
    raw = spark.createDataFrame([(1, 1, quiz_json("é", "b")), (2, 1, quiz_json()), (3, 1, "no")], schemas.RESPONSES)
    headers = spark.createDataFrame([(1, 42), (2, 43)], "request_id bigint, quiz_id bigint")
    documents = responses.export_documents(responses.curated_quizzes(raw), pretty=True)
    files = responses.export_files(documents, headers).withColumnRenamed("document", "content")
    note_files.write_files(files, str(tmp_path / "out"))
    found = {
        row.path.rsplit("/", 1)[-1]: bytes(row.content).decode()
        for row in note_files.read_written_files(spark, str(tmp_path / "out")).collect()
    }
    assert found.keys() == {"quiz_42.json", "quiz_43.json"}
    assert [q["question"] for q in json.loads(found["quiz_42.json"])["questions"]] == ["é", "b"]
    assert "\n  " in found["quiz_42.json"] and json.loads(found["quiz_43.json"]) == {"questions": []}
