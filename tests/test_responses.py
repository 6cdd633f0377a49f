import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake import schemas
from quizlake.functions import quiz_json
from quizlake.operators import responses
from quizlake.plans.derived import QuizData
from quizlake.plans.queries import registered
from tests.plans import count, initial_plan

Q = '{"question":"q","options":["a","b","c","d"],"answer":0}'


def with_answer(answer):
    return '{"questions":[{"question":"q","options":["a","b","c","d"],"answer":%s}]}' % answer


CASES = [
    ('{"questions":[%s]}' % Q, "ok"),
    ('```json\n{"questions":[%s]}\n```' % Q, "ok"),
    ('```\n{"questions":[%s]}```' % Q, "ok"),
    ('```JSON\n{"questions":[%s]}\n```' % Q, "ok"),
    ('  ```json {"questions":[%s]} ```　' % Q, "ok"),
    ('Sure!\n{"questions":[%s]}\nBye' % Q, "ok"),
    ('{"questions":[]} and {"questions":[]}', "invalid_json"),
    ('{"questions":[]}{"questions":[]}', "invalid_json"),
    ("{'questions':[]}", "invalid_json"),
    ('{"questions":[%s,]}' % Q, "invalid_json"),
    (with_answer("01"), "invalid_json"),
    ('{"questions":[{"question":"a\nb","options":["a","b","c","d"],"answer":0}]}', "invalid_json"),
    (None, "invalid_json"),
    ("", "invalid_json"),
    ("   ", "invalid_json"),
    ("I cannot do that.", "invalid_json"),
    ("```", "invalid_json"),
    ("[1,2]", "invalid_structure"),
    ("5", "invalid_structure"),
    ('"x"', "invalid_structure"),
    ("1,2", "invalid_json"),
    ("1],[2", "invalid_json"),
    ('1,"b":2', "invalid_json"),
    ("} {", "invalid_json"),
    ("[%s]" % Q, "invalid_structure"),
    ('{"questions":[]}', "ok"),
    ('{"questions":null}', "invalid_structure"),
    ('{"questions":{}}', "invalid_structure"),
    ('{"a":1}', "invalid_structure"),
    ('{"questions":[1]}', "invalid_structure"),
    ('{"questions":[null]}', "invalid_structure"),
    ('{"questions":[{"question":"q","options":["a","b","c","d"]}]}', "invalid_structure"),
    ('{"questions":[{"question":"q","answer":1}]}', "invalid_structure"),
    ('{"questions":[{"options":["a","b","c","d"],"answer":1}]}', "invalid_structure"),
    ('{"questions":[{"question":null,"options":["a","b","c","d"],"answer":1}]}', "ok"),
    ('{"questions":[{"question":"q","options":["a","b","c"],"answer":1}]}', "invalid_structure"),
    ('{"questions":[{"question":"q","options":["a","b","c","d","e"],"answer":1}]}', "invalid_structure"),
    ('{"questions":[{"question":"q","options":"abcd","answer":1}]}', "invalid_structure"),
    ('{"questions":[{"question":"q","options":{"a":1,"b":2,"c":3,"d":4},"answer":1}]}', "invalid_structure"),
    ('{"questions":[{"question":"q","options":[1,null,true,[2]],"answer":1}]}', "ok"),
    (with_answer('"2"'), "ok"),
    (with_answer('" 2 "'), "ok"),
    (with_answer('"+1"'), "ok"),
    (with_answer("2.9"), "ok"),
    (with_answer("3e0"), "ok"),
    (with_answer("true"), "ok"),
    (with_answer("false"), "ok"),
    (with_answer("-0.9"), "ok"),
    (with_answer("4"), "invalid_structure"),
    (with_answer("-1"), "invalid_structure"),
    (with_answer("1e30"), "invalid_structure"),
    (with_answer("12345678901234567890123"), "invalid_structure"),
    (with_answer('"2.0"'), "invalid_structure"),
    (with_answer('""'), "invalid_structure"),
    (with_answer("null"), "invalid_structure"),
    (with_answer("[1]"), "invalid_structure"),
    ('{"questions":[%s,{"question":"q"},%s]}' % (Q, Q), "invalid_structure"),
    ('{"questions":[1],"questions":[]}', "ok"),
    ('{"questions":[],"questions":[1]}', "invalid_structure"),
    # Texts that hold the marker the parser puts behind the document.
    ('{"questions":[],"x":"quizlake-end-of-document"}', "ok"),
    ('"x","quizlake-end-of-document"] "', "invalid_json"),
    ('1,"quizlake-end-of-document"]', "invalid_json"),
]


def python_answer(item):
    """The number of the right option, None if the item breaks a rule."""
    if not isinstance(item, dict) or any(k not in item for k in ("question", "options", "answer")):
        return None
    options = item["options"]
    if type(options) is not list or len(options) != 4:
        return None
    try:
        number = int(item["answer"])
    except (TypeError, ValueError, OverflowError):
        return None
    return number if number in range(4) else None


def python_status(raw):
    """The same rules on one text, in plain Python."""
    text = (raw or "").strip()
    if text.startswith("```"):
        text = text[3:].removeprefix("json").lstrip()
    if text.endswith("```"):
        text = text[:-3].rstrip()
    first, last = text.find("{"), text.rfind("}")
    try:
        document = json.loads(text[first : last + 1] if 0 <= first < last else text)
    except ValueError:
        return "invalid_json", None
    items = document.get("questions") if isinstance(document, dict) else None
    if type(items) is not list:
        return "invalid_structure", None
    answers = [python_answer(item) for item in items]
    return ("invalid_structure", None) if None in answers else ("ok", answers)


def frame(spark, texts):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], schemas.RESPONSES)


def judge(spark, texts):
    rows = responses.judge_responses(frame(spark, texts)).collect()
    return [r for r in sorted(rows, key=lambda r: r["request_id"])]


def test_golden_statuses(spark):
    got = judge(spark, [t for t, _ in CASES])
    wrong = [(CASES[r["request_id"]], r["status"]) for r in got if r["status"] != CASES[r["request_id"]][1]]
    assert wrong == []


def test_golden_cases_agree_with_plain_python(spark):
    for (text, expected), row in zip(CASES, judge(spark, [t for t, _ in CASES])):
        status, answers = python_status(text)
        assert status == expected, text
        if status == "ok":
            assert [q["answer"] for q in row["questions"]] == answers, text


JSONISH = st.recursive(
    st.none()
    | st.booleans()
    | st.integers(-5, 5)
    | st.floats(-4, 4).map(lambda x: round(x, 2))
    | st.sampled_from(["", "2", " 1 ", "2.0", "x", "{", "}", "```", "é"]),
    lambda inner: st.lists(inner, max_size=5)
    | st.dictionaries(
        st.sampled_from(["questions", "question", "options", "answer", "explanation"]), inner, max_size=5
    ),
    max_leaves=12,
)
ITEM = st.fixed_dictionaries(
    {
        "question": JSONISH,
        "options": st.lists(JSONISH, min_size=3, max_size=5),
        "answer": st.integers(-1, 4) | st.sampled_from(["1", " 2", "x", 2.5, None, True]),
    },
    optional={"explanation": JSONISH},
)
DOCUMENT = st.one_of(JSONISH, st.fixed_dictionaries({"questions": st.lists(ITEM, max_size=3)}))
NOISE = st.sampled_from(["", "", "```json\n", "```", "Here: ", " } ", "{", "\n", "　", "]", ",", "1"])


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(NOISE, DOCUMENT, NOISE), min_size=10, max_size=40))
def test_statuses_equal_plain_python(spark, parts):
    texts = [before + json.dumps(doc) + after for before, doc, after in parts]
    for text, row in zip(texts, judge(spark, texts)):
        status, answers = python_status(text)
        assert row["status"] == status, text
        if status == "ok":
            assert [q["answer"] for q in row["questions"]] == answers


def test_normalisation(spark):
    text = (
        '{"questions":[{"question":"é","options":["a",1,null,true],"answer":"3"},'
        '{"question":null,"options":["a","b","c","d"],"answer":1.9,"explanation":null},'
        '{"question":"q","options":["a","b","c","d"],"answer":0,"explanation":"why"}]}'
    )
    questions = judge(spark, [text])[0]["questions"]
    assert [tuple(q) for q in questions] == [
        ("é", ["a", "1", None, "true"], 3, ""),
        (None, ["a", "b", "c", "d"], 1, None),
        ("q", ["a", "b", "c", "d"], 0, "why"),
    ]


def test_many_braces_stay_cheap(spark):
    texts = ["{" * 200_000, "}" * 200_000, "{ " * 50_000 + "}" * 10]
    assert [r["status"] for r in judge(spark, texts)] == ["invalid_json"] * 3


def test_long_response_is_read_whole(spark):
    many = '{"questions":[%s]}' % ",".join([Q] * 60_000)
    broken = many[:-2] + ',{"question":"q"}]}'
    got = judge(spark, [many, broken])
    assert [r["status"] for r in got] == ["ok", "invalid_structure"]
    assert len(got[0]["questions"]) == 60_000


def test_first_valid_attempt(spark, rows_of):
    good, bad, worse = '{"questions":[%s]}' % Q, "no", '{"questions":1}'
    raw = spark.createDataFrame(
        [(1, 1, bad), (1, 2, worse), (1, 3, good)]
        + [(2, 1, bad), (2, 2, bad), (2, 3, worse)]
        + [(3, 1, bad), (3, 2, worse), (3, 3, bad), (3, 4, good)]
        + [(4, 2, good), (4, 1, '{"questions":[]}')]
        + [(5, 1, worse)],
        schemas.RESPONSES,
    )
    chosen = responses.first_valid(responses.judge_responses(raw))
    assert rows_of(chosen, "request_id", "status", "attempt", "error", "n_questions") == [
        (1, "ready", 3, None, 1),
        (2, "failed", None, "Failed after 3 attempts: Model returned invalid quiz structure", None),
        (3, "failed", None, "Failed after 3 attempts: Invalid JSON from model", None),
        (4, "ready", 1, None, 0),
        (5, "failed", None, "Failed after 3 attempts: Model returned invalid quiz structure", None),
    ]
    assert rows_of(responses.curated_questions(responses.curated_quizzes(raw)), "request_id", "position") == [(1, 0)]


@pytest.mark.parametrize("pretty", [False, True])
def test_export_is_the_generated_document(spark, pretty):
    document = {
        "questions": [
            {"question": "é \"x\"\n", "options": ["a", "b", "c", "d"], "answer": 2, "explanation": ""},
            {"question": None, "options": ["a", "b", "c", "d"], "answer": 0, "explanation": None},
        ]
    }
    source = json.loads(json.dumps(document))
    del source["questions"][0]["explanation"]
    curated = responses.curated_quizzes(frame(spark, [json.dumps(source)]))
    text = responses.export_documents(curated, pretty).collect()[0]["document"]
    assert json.loads(text) == document
    assert ("\n" in text) == pretty


@pytest.mark.parametrize("pretty", [False, True])
def test_export_keeps_every_key_and_type(spark, pretty):
    item = {"question": 7, "options": [1, {"x": [None, 2.5]}, "c", None], "answer": " 2 ", "hint": {"h": [True]}}
    source = {"title": "T \"x\"", "questions": [item, {**item, "explanation": 5}], "level": None}
    curated = responses.curated_quizzes(frame(spark, [json.dumps(source)]))
    text = responses.export_documents(curated, pretty).collect()[0]["document"]
    first, second = ({**q, "answer": 2} for q in source["questions"])
    assert json.loads(text) == {**source, "questions": [{**first, "explanation": ""}, second]}
    assert ("\n" in text) == pretty


def test_options_round_trip(spark):
    encoded = json.dumps(["a", "é", 'b"', ""])
    row = spark.createDataFrame([(encoded,)], "o string").select(
        quiz_json.decode_options(F.col("o")).alias("d"),
        quiz_json.encode_options(quiz_json.decode_options(F.col("o"))).alias("e"),
    ).collect()[0]
    assert row["d"] == ["a", "é", 'b"', ""] and json.loads(row["e"]) == row["d"]


def test_curation_runs_no_python(spark):
    plan = initial_plan(responses.first_valid(responses.judge_responses(frame(spark, ["{}"]))))
    assert "Python" not in plan
    assert count(plan, "Exchange") == 1 and count(plan, "SortAggregate") == 0


@pytest.mark.parametrize("whole", [False, True])
def test_curation_parses_each_text_once(spark, whole):
    """Three parses, as in the judgement alone: the sealed one and two for texts that hold the seal."""
    raw = spark.range(10).select(
        F.col("id").alias("request_id"), F.lit(1).alias("attempt"), F.col("id").cast("string").alias("raw_text")
    )
    stored = responses.judged_payloads(raw, whole=whole)
    assert "Generate" not in initial_plan(stored)
    assert stored._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 3
    curated = responses.curated_quizzes(raw, whole=whole)
    plan = curated._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 0
    assert ("generated" in curated.columns) == whole


def test_one_reader_of_curated_responses_stores_nothing(spark, rows_of):
    """The winners as the store has them, each text parsed once, without a store."""
    good = '{"questions":[{"question":"%s","options":["a","b","c","d"],"answer":1}]}'
    texts = [(1, 1, "no"), (1, 2, good % "x"), (1, 3, good % "y"), (2, 1, "no"), (3, 2, good % "z"), (3, 2, good % "w"), (3, 3, None)]
    raw = spark.createDataFrame([*texts, (None, 1, good % "v"), (4, 4, good % "late")], "request_id long, attempt int, raw_text string")
    lazy = responses.curated_quizzes(raw, whole=False, stored=False)
    found = responses.curated_questions(lazy)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 3
    assert "FileScan" not in initial_plan(found)
    assert rows_of(found, "request_id", "question") == [(1, "x"), (3, "w"), (3, "z")]
    stored = responses.curated_questions(responses.curated_quizzes(raw, whole=False))
    assert rows_of(found, *found.columns) == rows_of(stored, *found.columns)


def test_curated_queries_write_no_store(spark, monkeypatch, tmp_path):
    def refuse(*args):
        raise AssertionError("stored for a single reader")

    monkeypatch.setattr(responses, "store_bucketed", refuse)
    lines = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    spark.createDataFrame([(k, 1, k, k) for k in range(1, 17)], lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("curated_questions", "quiz_export"):
        assert registered()[name](spark, str(tmp_path)).count() > 0


LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"


def test_code_of_the_response_texts_is_short_enough_to_be_compiled(spark, sql_settings, tmp_path):
    """The JVM never compiles a method of more than 8,000 bytes: it would be interpreted row by row."""
    spark.createDataFrame([(k, 1, k, k) for k in range(1, 17)], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    sql_settings(spark__sql__adaptive__enabled="false")
    curated = responses.curated_quizzes(QuizData(spark, str(tmp_path)).responses(), stored=False)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    code = debug.codegenString(curated._jdf.queryExecution().executedPlan())
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_raw_texts_are_dealt_out_before_the_parse(spark):
    raw = spark.createDataFrame([(1, 1, "no"), (1, 2, '{"questions":[%s]}' % Q)], schemas.RESPONSES)
    curated = responses.curated_quizzes(raw, stored=False)
    plan = curated._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 3 and "parseJson" not in plan[plan.index("RepartitionByExpression") :]
    assert initial_plan(curated).count("Exchange") == 1


def test_plain_documents_are_written_from_their_questions(spark):
    """The same text as key by key, where keys, types and nulls differ as well as where they do not."""
    options = ["a\n\"\\é/", "", None, "\u2028😀"]
    plain = {"question": "q\tö", "options": options, "answer": 3, "explanation": "e"}
    items = [
        [plain],
        [],
        [plain, {**plain, "explanation": None}],
        [{**plain, "question": None}, plain],
        [{**plain, "options": [1, 2.5, True, {"x": [None]}]}],
        [{**plain, "question": {"q": "x"}}, plain],
        [{**plain, "explanation": 5}, plain],
        [{**plain, "hint": "h"}, plain],
        [{**plain, "options": [None] * 4}],
    ]
    documents = [{"questions": listed} for listed in items] + [{"questions": [plain], "title": "t"}]
    sources = [json.dumps(d, ensure_ascii=False) for d in documents]
    for answer in ('" 3 "', "3.2", "true"):
        sources.append(sources[0].replace('"answer": 3', f'"answer": {answer}'))
        documents.append({"questions": [{**plain, "answer": 1 if answer == "true" else 3}]})
    short = {key: plain[key] for key in ("question", "options", "answer")}
    sources.append(json.dumps({"questions": [short, plain]}))
    documents.append({"questions": [{**short, "explanation": ""}, plain]})
    exported = responses.export_documents(responses.curated_quizzes(frame(spark, sources), stored=False))
    assert "schema_of_variant" in exported._jdf.queryExecution().optimizedPlan().toString().lower().replace("schemaofvariant", "schema_of_variant")
    texts = [row.document for row in sorted(exported.collect())]
    assert texts == [json.dumps(d, ensure_ascii=False, separators=(",", ":")) for d in documents]
