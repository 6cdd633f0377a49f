"""The physical plans of the registered queries, with broadcasting by size switched off."""

import os
import re

import pytest

from quizlake.plans.queries import registered
from tests.plans import count, initial_plan

FOLDER = "/root/testdata/sf0.001"
NEEDS_PYTHON = {"notes_decoded", "note_files"}
EAGER = {"streamed_attempts"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


@pytest.fixture(scope="module")
def plans(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return {
            name: initial_plan(build(spark, FOLDER))
            for name, build in registered().items()
            if name not in EAGER
        }
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_nested_loops(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_python_only_where_stated(plans):
    assert {n for n, p in plans.items() if "Python" in p or "MapInPandas" in p} <= NEEDS_PYTHON


def test_explicit_broadcasts_are_the_bounded_ones(plans):
    assert not {n for n, p in plans.items() if "BroadcastHashJoin" in p}


def test_rank_limits_run_before_the_shuffle(plans):
    for name in ("latest_quizzes_per_module", "module_quizzes", "modules_per_user", "default_quiz"):
        assert re.search(r"WindowGroupLimit.*Partial", plans[name]), name


def test_scans_read_what_is_used(plans):
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plans["question_numbers"])
    columns = {c.split(":")[0] for scan in scans for c in scan.split(",")}
    assert columns == {"l_orderkey", "l_linenumber"}
    assert "html" not in plans["note_fingerprints"] and "n_chars" not in plans["note_fingerprints"]


def test_attempt_limit_reaches_the_raw_rows(plans):
    plan = plans["first_valid_attempt"]
    assert re.search(r"Filter \(\(_place#\d+ \+ 1\) <= 3\)\s+\+- Generate", plan)


def test_progress_is_one_aggregate_over_scoring(plans):
    assert count(plans["progress_summary"], "Window") == 0
    assert plans["progress_summary"].count("rangepartitioning") == 0


def test_sorted_output_is_range_partitioned(plans):
    assert "rangepartitioning(user_id" in plans["performance_trend"]


def test_point_lookups_are_pushed_down(spark, tmp_path):
    from quizlake.operators import catalog
    from quizlake.plans.derived import QuizData
    from quizlake.sources import tables

    data = QuizData(spark, FOLDER)
    root = str(tmp_path)
    tables.write_table(data.quizzes(), root, "quizzes")
    quizzes = tables.read_table(spark, root, "quizzes")
    frame = catalog.quiz_list(quizzes, 4, 21)
    plan = initial_plan(frame)
    assert "EqualTo(user_id,4)" in plan and "EqualTo(module_id,21)" in plan
    assert "TakeOrderedAndProject" in plan
    scan = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "notes_hash" not in scan
