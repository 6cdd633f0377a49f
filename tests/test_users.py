import random
import re

import pytest

from quizlake.functions.text import EMAIL_PATTERN
from quizlake.operators import users
from tests.plans import count, final_plan, initial_plan

USERS = "user_id bigint, username string, email string"
BATCH = "seq bigint, username string, email string"


def test_identities(spark):
    people = spark.createDataFrame(
        [
            (1, "Ann", "ann@x.org"),
            (2, "ANN", "second@x.org"),
            (3, "bob@x.org", "b@x.org"),
            (4, "Bea", "BOB@x.org"),
            (5, "é", "e@x.org"),
            (6, None, "only@x.org"),
        ],
        USERS,
    )
    asked = {
        "ann": 1, "aNN": 1, " SECOND@X.ORG\t": 2, "bob@X.org": 3, "bea": 4, "É": None, "é": 5,
        "nobody": None, "only@x.ORG": 6,
    }
    lookups = [(i, k) for i, k in enumerate(asked)] + [(100, "  "), (101, None), (102, "")]
    frame = spark.createDataFrame(lookups, "lookup_id bigint, identifier string")
    got = {r["lookup_id"]: r for r in users.resolve_identifiers(frame, people).collect()}
    assert len(got) == len(lookups)
    for i, wanted in enumerate(asked.values()):
        assert got[i]["user_id"] == wanted
        assert got[i]["status"] == ("found" if wanted else "not_found")
    assert {got[i]["status"] for i in (100, 101, 102)} == {"blank"}


def test_identity_lookup_is_an_equi_join(spark, sql_settings):
    sql_settings(spark__sql__autoBroadcastJoinThreshold="-1")
    people = spark.createDataFrame([(1, "a", "a@x.org")], USERS)
    lookups = spark.createDataFrame([(1, "a")], "lookup_id bigint, identifier string")
    plan = initial_plan(users.resolve_identifiers(lookups, people))
    assert count(plan, "SortMergeJoin") == 1
    assert count(plan, "BroadcastNestedLoopJoin") == count(plan, "CartesianProduct") == 0


def one_by_one(batch, people):
    """Insert row after row into two sets."""
    taken_names, taken_emails = {u[1] for u in people}, {u[2] for u in people}
    verdicts = {}
    for seq, raw_name, raw_email in sorted(batch):
        name = raw_name.strip() if raw_name else ""
        email = raw_email.strip().lower() if raw_email else ""
        verdict = users.ACCEPTED
        if email in taken_emails:
            verdict = users.EMAIL_TAKEN
        if name in taken_names:
            verdict = users.NAME_TAKEN
        if not re.search(EMAIL_PATTERN, email):
            verdict = users.BAD_EMAIL
        if name == "":
            verdict = users.NAME_MISSING
        if verdict == users.ACCEPTED:
            taken_names.add(name)
            taken_emails.add(email)
        verdicts[seq] = verdict
    return verdicts


def import_verdicts(spark, batch, people):
    got = users.import_users(
        spark.createDataFrame(batch, BATCH), spark.createDataFrame(people, USERS)
    ).collect()
    assert len(got) == len(batch)
    assert all(r["accepted"] == (r["message"] == users.ACCEPTED) for r in got)
    return {r["seq"]: r["message"] for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_import_equals_one_by_one(spark, seed):
    random.seed(seed)
    people = [(i, f"n{i}", f"e{i}@x.org") for i in range(5)]
    batch = [
        (
            seq,
            random.choice([None, " ", *[f" n{i}\t" for i in range(30)], *["n7"] * 10]),
            random.choice(["bad", None, *[f" E{i}@x.org" for i in range(30)], *["e9@X.org"] * 10]),
        )
        for seq in range(200)
    ]
    assert import_verdicts(spark, batch, people) == one_by_one(batch, people)


def test_a_refused_rival_blocks_nobody(spark):
    batch = [(1, "a", "a@x.org"), (2, "a", "b@x.org"), (3, "c", "b@x.org"), (4, "c", "d@x.org"), (5, "e", "d@x.org")]
    verdicts = import_verdicts(spark, batch, [])
    assert verdicts == one_by_one(batch, [])
    assert verdicts[3] == verdicts[5] == users.ACCEPTED


def test_a_taken_name_is_reported_before_a_taken_email(spark):
    people = [(1, "old", "old@x.org")]
    batch = [(1, "new", "new@x.org"), (2, "new", "old@x.org"), (3, "other", "old@x.org")]
    verdicts = import_verdicts(spark, batch, people)
    assert verdicts[2] == users.NAME_TAKEN and verdicts[3] == users.EMAIL_TAKEN


def test_import_has_no_nested_loop(spark):
    people = spark.createDataFrame([(1, "a", "a@x.org")], USERS)
    batch = spark.createDataFrame([(1, "b", "b@x.org")], BATCH)
    plan = final_plan(users.import_users(batch, people))
    assert count(plan, "BroadcastNestedLoopJoin") == count(plan, "CartesianProduct") == 0


def test_a_long_chain_of_rivals_takes_few_rounds(spark, monkeypatch):
    """Every row shares its name with the row before and its email with the one behind, or the other way."""
    n = 10_000
    batch = [(k, f"n{k // 2}", f"e{(k + 1) // 2}@x.org") for k in range(n)]
    frame = spark.createDataFrame(batch, BATCH)
    rounds = []
    cut = users.cut_lineage
    monkeypatch.setattr(users, "cut_lineage", lambda frame: rounds.append(1) or cut(frame))
    verdicts = users.import_users(frame, spark.createDataFrame([], USERS))
    got = {r["seq"]: r["message"] for r in verdicts.collect()}
    assert len(rounds) < 20
    assert got == one_by_one(batch, [])
