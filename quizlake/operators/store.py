"""Keeping the six tables right: get-or-create, save, replace, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions.text import strip_or_empty
from quizlake.operators.keys import assign_blocks, assign_ids
from quizlake.schemas import FOREIGN_KEYS


def new_modules(requests: DataFrame, modules: DataFrame, run_time: str) -> DataFrame:
    """Module rows for requested (user_id, module_name) pairs that do not exist yet.

    Names are stripped and matched by case; blank ones create nothing.
    """
    wanted = (
        requests.select("user_id", strip_or_empty(F.col("module_name")).alias("module_name"))
        .filter(F.col("module_name") != "")
        .distinct()
    )
    absent = wanted.join(modules, ["user_id", "module_name"], "left_anti")
    return assign_ids(absent, "module_id", ["user_id", "module_name"], existing=modules).select(
        "module_id",
        "user_id",
        "module_name",
        F.to_timestamp_ntz(F.lit(run_time)).alias("created_at"),
    )


def get_or_create_modules(requests: DataFrame, modules: DataFrame, run_time: str) -> DataFrame:
    """The module id for each request (request_id, user_id, module_name); null for a blank name."""
    created = new_modules(requests, modules, run_time)
    known = (
        modules.select("user_id", "module_name", "module_id")
        .withColumn("created", F.lit(False))
        .unionByName(
            created.select("user_id", "module_name", "module_id").withColumn("created", F.lit(True))
        )
    )
    named = requests.select(
        "request_id", "user_id", strip_or_empty(F.col("module_name")).alias("module_name")
    )
    opened = named.filter(F.col("module_name") != "").join(
        known, ["user_id", "module_name"], "left"
    )
    nameless = named.filter(F.col("module_name") == "").select(
        "request_id",
        "user_id",
        "module_name",
        F.lit(None).cast("bigint").alias("module_id"),
        F.lit(False).alias("created"),
    )
    return opened.select(*nameless.columns).unionByName(nameless)


def _highest(existing: DataFrame | None, column: str) -> Column:
    none = F.lit(0).cast("bigint")
    return none if existing is None else F.coalesce(existing.agg(F.max(column)).scalar(), none)


def quiz_ids(curated: DataFrame, quizzes: DataFrame | None, questions: DataFrame | None = None) -> DataFrame:
    """request_id, quiz_id and ``before``, the id below that of the first question, of generated quizzes."""
    # Questions are written first: a save that ended between the two left ids in them alone.
    known = None if quizzes is None else quizzes.select("quiz_id")
    if known is not None and questions is not None:
        known = known.unionByName(questions.select("quiz_id"))
    size = F.when(F.col("questions").isNotNull(), F.size("questions")).otherwise(0)
    if "n_questions" in curated.columns:  # the texts need not be read for their number
        size = F.col("n_questions")
    return assign_blocks(curated, "_place", "_members", "request_id", size).select(
        "request_id",
        (_highest(known, "quiz_id") + F.col("_place")).alias("quiz_id"),
        (_highest(questions, "question_id") + F.col("_members")).alias("before"),
    )


def quiz_headers(
    curated: DataFrame,
    requests: DataFrame,
    quizzes: DataFrame | None,
    run_time: str,
    questions: DataFrame | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Quiz rows for generated quizzes, keeping request_id to tie questions to them.

    ``curated`` has request_id and questions; ``requests`` has request_id, user_id, module_id,
    notes_hash and difficulty. ``ids`` is what ``quiz_ids`` gives, if the caller has stored it.
    """
    numbered = (quiz_ids(curated, quizzes, questions) if ids is None else ids).select("request_id", "quiz_id")
    return numbered.join(requests, "request_id").select(
        "request_id",
        "quiz_id",
        "user_id",
        "module_id",
        F.to_timestamp_ntz(F.lit(run_time)).alias("timestamp"),
        "notes_hash",
        "difficulty",
    )


def question_rows(
    curated: DataFrame, headers: DataFrame, questions: DataFrame | None, ids: DataFrame | None = None
) -> DataFrame:
    """Question rows of saved quizzes; ids ascend in the order of the generated list.

    Quizzes are numbered by their sizes, so that their texts are not dealt out by number.
    """
    numbered = quiz_ids(curated, None, questions) if ids is None else ids
    placed = numbered.select("request_id", "before").join(headers.select("request_id", "quiz_id"), "request_id")
    return (
        curated.select("request_id", "questions")
        .join(placed, "request_id")
        .select("quiz_id", "before", F.posexplode("questions").alias("position", "q"))
        .select(
            (F.col("before") + F.col("position") + 1).cast("bigint").alias("question_id"),
            "quiz_id",
            F.col("q.question").alias("question_text"),
            F.col("q.options").alias("options"),
            F.col("q.answer").alias("correct_answer"),
            F.col("q.explanation").alias("explanation"),
        )
    )


def latest_submissions(submissions: DataFrame) -> DataFrame:
    """The last submission per user and quiz; the rank limit also runs before the shuffle."""
    last_first = Window.partitionBy("user_id", "quiz_id").orderBy(
        F.desc("submitted_at"), F.desc("submission_id")
    )
    return (
        submissions.withColumn("_place", F.row_number().over(last_first))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def replace_answers(
    stored: DataFrame, batch: DataFrame, batch_submissions: DataFrame
) -> DataFrame:
    """user_answers after a batch, whole and without ids: the last submission per user and quiz replaces all.

    ``batch`` holds the graded answers of ``batch_submissions`` (submission_id, user_id,
    quiz_id, submitted_at). A submission of a quiz without questions also clears old answers.
    Stored rows with submitted_at and submission_id stay if they are later; without, the batch counts as
    later. ``answers.save_answers`` keeps the stored table, with ids, and rewrites what a batch touches.
    """
    last = latest_submissions(batch_submissions).select("submission_id", "user_id", "quiz_id", "submitted_at")
    if {"submitted_at", "submission_id"} <= set(stored.columns):
        mark = F.struct("submitted_at", "submission_id")
        known = stored.groupBy("user_id", "quiz_id").agg(F.max(mark).alias("_known"))
        last = last.join(known, ["user_id", "quiz_id"], "left").filter(
            F.col("_known").isNull() | (mark >= F.col("_known"))
        )
    last = last.select("submission_id", "user_id", "quiz_id")
    kept = stored.join(last, ["user_id", "quiz_id"], "left_anti")
    fresh = batch.join(last.select("submission_id"), "submission_id", "left_semi")
    columns = ["user_id", "quiz_id", "question_id", "user_answer", "is_correct"]
    return kept.select(*columns).unionByName(fresh.select(*columns))


def audit_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose foreign key finds no parent: fk, child_id, missing_key.

    Each child table is read once and unpivoted to one narrow row per non-null foreign key,
    each parent's ids once, and a single anti join settles all nine keys. A null key is
    allowed. Links and parents travel as numbers; names are put back on what is found.
    """
    parents = list(dict.fromkeys((parent, key) for *_, parent, key in FOREIGN_KEYS))
    names = F.array(*[F.lit(f"{child}.{column}") for child, _, column, *_ in FOREIGN_KEYS])
    references = []
    for table in dict.fromkeys(child for child, *_ in FOREIGN_KEYS):
        links = [
            F.struct(
                F.lit(number).alias("link"),
                F.lit(parents.index((parent, key))).alias("parent"),
                F.col(column).cast("bigint").alias("missing_key"),
                F.col(child_key).cast("bigint").alias("child_id"),
            )
            for number, (child, child_key, column, parent, key) in enumerate(FOREIGN_KEYS)
            if child == table
        ]
        references.append(
            tables[table]
            .select(F.explode(F.array(*links)).alias("r"))
            .select("r.*")
            .filter(F.col("missing_key").isNotNull())
        )
    known = [
        tables[parent].select(F.col(key).cast("bigint").alias("missing_key"), F.lit(number).alias("parent"))
        for number, (parent, key) in enumerate(parents)
    ]
    return (
        reduce(DataFrame.unionByName, references)
        .join(reduce(DataFrame.unionByName, known), ["missing_key", "parent"], "left_anti")
        .select(F.get(names, F.col("link")).alias("fk"), "child_id", "missing_key")
    )
