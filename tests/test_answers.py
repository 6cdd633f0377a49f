"""The stored answers: one rule for the last submission, ids, and what a save rewrites."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from quizlake import schemas
from quizlake.operators import answers as stored_answers
from quizlake.operators import store
from quizlake.sources import tables
from quizlake.streaming import submissions as feed

T0 = dt.datetime(2024, 5, 1)
ANSWERS = "submission_id bigint, question_id bigint, user_answer int, is_correct int"
FORMS = "submission_id bigint, user_id bigint, quiz_id bigint, submitted_at timestamp_ntz"


def batch(spark, *forms):
    """Forms (submission_id, user_id, quiz_id, day, choices); a choice of 0 is right."""
    headers = [(s, u, q, T0 + dt.timedelta(days=day)) for s, u, q, day, _ in forms]
    given = [(s, 10 * q + n, c, int(c == 0)) for s, u, q, _, choices in forms for n, c in enumerate(choices)]
    return spark.createDataFrame(given, ANSWERS), spark.createDataFrame(headers, FORMS)


def saved(spark, root):
    rows = stored_answers.read_answers(spark, root).collect()
    return {(r.user_id, r.quiz_id, r.question_id): (r.submission_id, r.user_answer) for r in rows}


def files(root):
    return set(glob.glob(f"{root}/user_answers/part=*/*.parquet"))


def test_a_save_rewrites_only_the_parts_it_touches(spark, tmp_path):
    root = str(tmp_path)
    many = [(k, k, 1, 0, (0, 1)) for k in range(40)]
    stored_answers.save_answers(*batch(spark, *many), root, "a", parts=16)
    before = files(root)
    parts = {path.split("part=")[1].split("/")[0] for path in before}
    assert len(parts) > 8
    stored_answers.save_answers(*batch(spark, (100, 7, 1, 3, (2, 2))), root, "b", parts=16)
    after = files(root)
    gone = {path.split("part=")[1].split("/")[0] for path in before - after}
    assert len(gone) == 1 and {path.split("part=")[1].split("/")[0] for path in after - before} == gone
    now = saved(spark, root)
    assert now[7, 1, 10] == (100, 2) and now[8, 1, 10] == (8, 0) and len(now) == 80
    ids = [r.answer_id for r in stored_answers.read_answers(spark, root).collect()]
    assert len(set(ids)) == 80 and sorted(ids)[-2:] == [81, 82]
    assert tables.conform(stored_answers.read_answers(spark, root), "user_answers").schema == schemas.USER_ANSWERS


def test_late_forms_and_replays_change_nothing(spark, tmp_path):
    root = str(tmp_path)
    stored_answers.save_answers(*batch(spark, (5, 1, 1, 5, (1,)), (6, 1, 1, 5, (2,))), root, "a", parts=4)
    assert saved(spark, root) == {(1, 1, 10): (6, 2)}
    ids = [r.answer_id for r in stored_answers.read_answers(spark, root).collect()]
    for run, form in (("late", (4, 1, 1, 2, (0,))), ("same time", (3, 1, 1, 5, (0,))), ("again", (6, 1, 1, 5, (2,)))):
        stored_answers.save_answers(*batch(spark, form), root, run, parts=4)
        assert saved(spark, root) == {(1, 1, 10): (6, 2)}
        assert [r.answer_id for r in stored_answers.read_answers(spark, root).collect()] == ids
    # A recorded run is not done twice, whatever it is given.
    stored_answers.save_answers(*batch(spark, (9, 1, 1, 9, (0,))), root, "late", parts=4)
    assert saved(spark, root) == {(1, 1, 10): (6, 2)}


def test_a_form_of_an_empty_quiz_clears_older_answers_for_good(spark, tmp_path):
    root = str(tmp_path)
    stored_answers.save_answers(*batch(spark, (1, 1, 1, 0, (0, 1))), root, "a", parts=4)
    stored_answers.save_answers(*batch(spark, (3, 1, 1, 4, ())), root, "b", parts=4)
    assert saved(spark, root) == {}
    stored_answers.save_answers(*batch(spark, (2, 1, 1, 2, (0, 1))), root, "c", parts=4)
    assert saved(spark, root) == {}


def test_a_save_that_ended_before_its_record_is_done_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    stored_answers.save_answers(*batch(spark, (1, 1, 1, 0, (0, 1)), (2, 2, 1, 0, (3, 3))), root, "a", parts=4)
    second = batch(spark, (3, 1, 1, 1, (2, 2)), (4, 3, 1, 1, (1, 1)))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(stored_answers, "record_run", lost)
        with pytest.raises(RuntimeError):
            stored_answers.save_answers(*second, root, "b", parts=4)
    stored_answers.save_answers(*second, root, "b", parts=4)
    assert saved(spark, root) == {
        (1, 1, 10): (3, 2), (1, 1, 11): (3, 2), (2, 1, 10): (2, 3), (2, 1, 11): (2, 3),
        (3, 1, 10): (4, 1), (3, 1, 11): (4, 1),
    }
    ids = [r.answer_id for r in stored_answers.read_answers(spark, root).collect()]
    assert len(set(ids)) == 6


def test_batch_store_and_feed_have_one_rule(spark, tmp_path, rows_of):
    """The later form arrives first: all three keep it."""
    forms = [batch(spark, (8, 1, 1, 4, (1, 2))), batch(spark, (9, 1, 1, 2, (0, 0)), (7, 2, 1, 1, (3, 3)))]
    columns = ["user_id", "quiz_id", "question_id", "user_answer", "is_correct"]
    logged, kept = None, None
    for number, (given, headers) in enumerate(forms):
        stored_answers.save_answers(given, headers, str(tmp_path), str(number), parts=4)
        graded = headers.join(given, "submission_id")
        logged = graded if logged is None else logged.unionByName(graded)
        if kept is None:
            kept = graded
        else:
            after = store.replace_answers(kept, graded, headers)
    expected = [(1, 1, 10, 1, 0), (1, 1, 11, 2, 0), (2, 1, 10, 3, 0), (2, 1, 11, 3, 0)]
    assert rows_of(stored_answers.read_answers(spark, str(tmp_path)), *columns) == expected
    assert rows_of(feed.current_answers(logged), *columns) == expected
    assert rows_of(after, *columns) == expected


def test_only_touched_parts_are_read(spark, tmp_path, sql_settings):
    root = str(tmp_path)
    stored_answers.save_answers(*batch(spark, *[(k, k, 1, 0, (0,)) for k in range(40)]), root, "a", parts=16)
    sql_settings(spark__sql__files__openCostInBytes="128m")  # a task per file
    table = stored_answers._read(spark, root)
    assert table.rdd.getNumPartitions() > 8
    assert table.filter(F.col("part").isin([3])).rdd.getNumPartitions() == 1
