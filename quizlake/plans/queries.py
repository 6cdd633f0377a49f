"""The registered queries: every operator over whole tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions.text import fingerprint, strip
from quizlake.operators import catalog, notes, progress, responses, scoring, store, users
from quizlake.operators.answers import read_answers, save_answers
from quizlake.operators.keys import assign_ids
from quizlake.plans.derived import QuizData
from quizlake.plans.journeys import prompts_from_parts, quizzes_from_responses
from quizlake.session import configure, scratch_path, store_once
from quizlake.sources import note_files as note_files_source
from quizlake.sources import tables
from quizlake.streaming import submissions as feed

RUN_TIME = "2024-01-01T00:00:00"
LIST_LENGTH = 3

_REGISTRY: dict[str, Callable[[QuizData], DataFrame]] = {}


def _query(build: Callable[[QuizData], DataFrame]) -> Callable[[QuizData], DataFrame]:
    _REGISTRY[build.__name__] = build
    return build


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, folder: build(QuizData(configure(spark), folder))

    return {name: bind(build) for name, build in _REGISTRY.items()}


def _scored(data: QuizData, on_missing: str = "wrong") -> DataFrame:
    return scoring.score_submissions(
        data.submissions(), data.choices(), data.questions(), on_missing
    )


def _performance(data: QuizData) -> DataFrame:
    return scoring.performance_rows(_scored(data))


def _answers(data: QuizData) -> DataFrame:
    return scoring.user_answer_rows(
        scoring.grade_answers(data.submissions(), data.choices(), data.questions())
    )


def _gated(data: QuizData) -> DataFrame:
    return notes.gate_notes(data.notes())


# --- tables -------------------------------------------------------------------------------


def _stored(data: QuizData, frame: DataFrame, name: str) -> DataFrame:
    """One of the six tables as written to a store, bucketed by its key, and scanned."""
    path = scratch_path(data.spark, name)
    table = f"{name}_{path.rsplit('-', 1)[-1]}"
    return tables.save_bucketed(frame, name, table, path, _buckets(data))


def _buckets(data: QuizData) -> int:
    return int(data.spark.conf.get("spark.sql.shuffle.partitions"))


@_query
def users_table(data: QuizData) -> DataFrame:
    return _stored(data, data.users(), "users").select("user_id", "username", "email")


@_query
def modules_table(data: QuizData) -> DataFrame:
    return _stored(data, data.modules(), "modules")


@_query
def quizzes_table(data: QuizData) -> DataFrame:
    return _stored(data, data.quizzes(), "quizzes").drop("notes_hash")


@_query
def questions_table(data: QuizData) -> DataFrame:
    return _stored(data, data.questions(), "questions").withColumn("options", F.to_json("options"))


@_query
def user_answers_table(data: QuizData) -> DataFrame:
    root = scratch_path(data.spark, "answers")
    data = data.with_stored_lines()
    save_answers(_answers(data), data.submissions(), root, "all", _buckets(data))
    return tables.conform(read_answers(data.spark, root), "user_answers")


@_query
def performance_table(data: QuizData) -> DataFrame:
    return _stored(data, _performance(data), "performance")


# --- scoring ------------------------------------------------------------------------------


@_query
def scored_attempts(data: QuizData) -> DataFrame:
    return _scored(data).select(
        "submission_id", "user_id", "module_id", "quiz_id", "score", "total", "percentage"
    )


@_query
def accepted_attempts(data: QuizData) -> DataFrame:
    return _scored(data, "reject").select("submission_id", "score", "total", "percentage")


@_query
def graded_answers(data: QuizData) -> DataFrame:
    graded = scoring.grade_answers(data.submissions(), data.choices(), data.questions())
    return graded.select("submission_id", "question_id", "user_answer", "is_correct")


@_query
def missing_answers(data: QuizData) -> DataFrame:
    return scoring.missing_answers(data.submissions(), data.choices(), data.questions())


@_query
def review_lines(data: QuizData) -> DataFrame:
    numbered = catalog.number_questions(data.questions())
    return scoring.review_lines(data.submissions(), data.choices(), numbered)


@_query
def grade_bands(data: QuizData) -> DataFrame:
    return scoring.result_lines(_scored(data))


# --- progress -----------------------------------------------------------------------------


@_query
def progress_summary(data: QuizData) -> DataFrame:
    # The last bits of a mean depend on the order of addition.
    return progress.progress_summary(_performance(data)).withColumn(
        "average", F.round("average", 6)
    )


@_query
def progress_metrics(data: QuizData) -> DataFrame:
    summary = progress.progress_summary(_performance(data))
    return progress.progress_metrics(summary.withColumn("average", F.round("average", 6)))


@_query
def performance_trend(data: QuizData) -> DataFrame:
    return progress.trend(_performance(data))


@_query
def performance_history(data: QuizData) -> DataFrame:
    return progress.history(_performance(data))


@_query
def trend_places(data: QuizData) -> DataFrame:
    return progress.trend_places(_performance(data))


@_query
def performance_sql(data: QuizData) -> DataFrame:
    return tables.query(
        data.spark,
        "SELECT user_id, module_id, timestamp, score, total, percentage FROM {performance} "
        "WHERE percentage BETWEEN :low AND :high ORDER BY timestamp, performance_id",
        {"low": 25.0, "high": 75.0},
        performance=_performance(data),
    )


# --- catalog ------------------------------------------------------------------------------


@_query
def latest_quizzes_per_module(data: QuizData) -> DataFrame:
    return catalog.latest_quizzes(data.quizzes(), LIST_LENGTH)


@_query
def module_quizzes(data: QuizData) -> DataFrame:
    return catalog.latest_quizzes(data.quizzes())


@_query
def module_list(data: QuizData) -> DataFrame:
    """The list that the first user is shown, looked up in the stored modules."""
    modules = _stored(data, data.modules(), "modules")
    user_id = modules.agg(F.min("user_id")).first()[0]
    return catalog.in_listed_order(catalog.module_list(modules, user_id), "module_name")


@_query
def quiz_list(data: QuizData) -> DataFrame:
    """The newest quizzes of the module that holds the newest quiz, at most two, and their places."""
    quizzes = _stored(data, data.quizzes(), "quizzes")
    user_id, module_id = quizzes.agg(F.max_by(F.struct("user_id", "module_id"), "quiz_id")).first()[0]
    listed = catalog.quiz_list(quizzes, user_id, module_id, 2)
    return catalog.in_listed_order(listed, F.desc("quiz_id"))


@_query
def loaded_quiz(data: QuizData) -> DataFrame:
    """The newest quiz, looked up in stored tables whose other buckets are not read."""
    quizzes = _stored(data, data.quizzes(), "quizzes")
    questions = _stored(data, data.questions(), "questions")
    newest = quizzes.agg(F.max("quiz_id")).first()[0]
    return catalog.load_quiz(quizzes, questions, newest).withColumn("questions", F.to_json("questions"))


@_query
def question_difficulty(data: QuizData) -> DataFrame:
    found = scoring.question_difficulty(_answers(data), data.questions())
    rounded = F.transform("option_shares", lambda share: F.format_string("%.6f", share))
    return found.withColumn("option_shares", F.when(F.col("answers") > 0, F.array_join(rounded, " ")))


@_query
def modules_per_user(data: QuizData) -> DataFrame:
    return catalog.modules_per_user(data.modules(), LIST_LENGTH)


@_query
def default_quiz(data: QuizData) -> DataFrame:
    return catalog.default_quizzes(data.quizzes(), data.selections(), LIST_LENGTH)


@_query
def quiz_labels(data: QuizData) -> DataFrame:
    return catalog.quiz_labels(data.quizzes())


@_query
def question_numbers(data: QuizData) -> DataFrame:
    return catalog.number_questions(data.questions()).select(
        "quiz_id", "question_id", "question_number"
    )


@_query
def quiz_documents(data: QuizData) -> DataFrame:
    documents = catalog.quiz_documents(data.quizzes(), data.questions())
    return documents.withColumn("questions", F.to_json("questions"))


# --- notes --------------------------------------------------------------------------------


@_query
def notes_assembled(data: QuizData) -> DataFrame:
    return notes.assemble_notes(data.note_parts())


@_query
def note_gate(data: QuizData) -> DataFrame:
    gated = _gated(data)
    return gated.withColumn("text", fingerprint(F.col("text")))


@_query
def notes_quarantined(data: QuizData) -> DataFrame:
    return notes.quarantined_notes(_gated(data))


@_query
def note_fingerprints(data: QuizData) -> DataFrame:
    return notes.fingerprint_notes(notes.accepted_notes(_gated(data)))


@_query
def duplicate_notes(data: QuizData) -> DataFrame:
    return notes.duplicate_notes(notes.accepted_notes(_gated(data)))


@_query
def note_previews(data: QuizData) -> DataFrame:
    return notes.preview_notes(notes.accepted_notes(_gated(data)))


@_query
def notes_decoded(data: QuizData) -> DataFrame:
    """Texts as bytes, every third with bytes that are not UTF-8, decoded again."""
    content = F.encode("text", "UTF-8")
    broken = F.concat(F.unhex(F.lit("FF")), content, F.unhex(F.lit("C3")))
    files = data.notes().select(
        "note_id", F.when(F.col("note_id") % 3 == 0, broken).otherwise(content).alias("content")
    )
    decoded = strip(note_files_source.decode_dropping_bad_bytes(F.col("content")))
    return files.select("note_id", decoded.alias("text"))


@_query
def note_files(data: QuizData) -> DataFrame:
    """Notes written as files of all extensions, some with bytes that are not UTF-8, read, routed and gated."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    broken = F.concat(F.unhex(F.lit("FF")), content, F.unhex(F.lit("C3")))
    path = scratch_path(data.spark, "note-files")
    written = data.notes().select(
        "file_name", F.when(F.col("note_id") % 3 == 0, broken).otherwise(content).alias("content")
    )
    note_files_source.write_files(written, path)
    found = note_files_source.notes_from_files(note_files_source.read_written_files(data.spark, path))
    gated = notes.gate_notes(found.withColumn("note_id", F.col("file_name")))
    kept = found.select(
        F.col("file_name").alias("note_id"),
        F.sha2("markup", 256).alias("markup_hash"),
        F.octet_length("content").alias("n_bytes"),
    )
    return gated.join(kept, "note_id").select(
        "file_name", "route", "status", fingerprint(F.col("text")).alias("text_hash"), "markup_hash", "n_bytes"
    )


@_query
def prompts(data: QuizData) -> DataFrame:
    return notes.build_prompts(data.prompt_requests())


# --- users, modules, integrity --------------------------------------------------------------


@_query
def identity_resolution(data: QuizData) -> DataFrame:
    return users.resolve_identifiers(data.lookups(), data.users_with_rivals())


@_query
def user_import_check(data: QuizData) -> DataFrame:
    return users.import_users(data.import_batch(), data.users())


@_query
def imported_users(data: QuizData) -> DataFrame:
    verdicts = users.import_users(data.import_batch(), data.users())
    return users.imported_users(verdicts, data.users(), RUN_TIME)


@_query
def prompts_from_notes(data: QuizData) -> DataFrame:
    """Parts to prompts: assembled, gated, stripped, filled in; refused notes get none."""
    files = data.note_parts().select("note_id").distinct().select(
        "note_id", F.concat(F.lit("n"), F.col("note_id").cast("string"), F.lit(".pdf")).alias("file_name")
    )
    settings = files.select("note_id", F.lit(10).alias("num_questions"), F.lit("Medium").alias("difficulty"))
    return prompts_from_parts(data.note_parts(), files, settings)


@_query
def module_upsert(data: QuizData) -> DataFrame:
    return store.get_or_create_modules(data.module_requests(), data.modules(), RUN_TIME)


@_query
def answers_replace(data: QuizData) -> DataFrame:
    """First attempts saved, then all of the quizzes taken twice, then late copies of their first ones."""
    root = scratch_path(data.spark, "answers")
    data = data.with_stored_lines()
    answers, submissions = store_once(_answers(data), "graded"), data.submissions()
    first_time = F.col("submission_id") % 10 == 1
    retaken = F.col("quiz_id") % 5 == 0
    save_answers(answers.filter(first_time), submissions.filter(first_time), root, "first", _buckets(data))
    save_answers(answers.filter(retaken), submissions.filter(retaken), root, "retaken", _buckets(data))
    late = first_time & retaken
    save_answers(answers.filter(late), submissions.filter(late), root, "late", _buckets(data))
    return tables.conform(read_answers(data.spark, root), "user_answers")


@_query
def fk_audit(data: QuizData) -> DataFrame:
    """Every foreign key broken in some rows, null in some others."""

    def damage(frame: DataFrame, column: str, by: str, step: int) -> DataFrame:
        key = F.col(column)
        damaged = F.when(F.col(by) % step == 0, key + 10**12).when(F.col(by) % step != 1, key)
        return frame.withColumn(column, damaged)

    answers = assign_ids(_answers(data), "answer_id", ["submission_id", "question_id"])
    frames = {
        "users": data.users(),
        "modules": damage(data.modules(), "user_id", "module_id", 97),
        "quizzes": damage(damage(data.quizzes(), "user_id", "quiz_id", 89), "module_id", "quiz_id", 83),
        "questions": damage(data.questions(), "quiz_id", "question_id", 101),
        "user_answers": damage(
            damage(damage(answers, "user_id", "answer_id", 103), "quiz_id", "answer_id", 107),
            "question_id", "answer_id", 109,
        ),
        "performance": damage(
            damage(_performance(data), "user_id", "performance_id", 113),
            "module_id", "performance_id", 127,
        ),
    }
    return store.audit_foreign_keys(frames)


# --- model responses --------------------------------------------------------------------------


@_query
def response_status(data: QuizData) -> DataFrame:
    return responses.judge_responses(data.responses()).select(
        "request_id", "attempt", "status", "message"
    )


@_query
def first_valid_attempt(data: QuizData) -> DataFrame:
    chosen = responses.first_valid(responses.judge_responses(data.responses()))
    return chosen.withColumn("n_questions", F.coalesce("n_questions", F.lit(0)))


@_query
def curated_questions(data: QuizData) -> DataFrame:
    curated = responses.curated_quizzes(data.responses(), whole=False, stored=False)
    return responses.curated_questions(curated).withColumn("options", F.to_json("options"))


@_query
def quiz_export(data: QuizData) -> DataFrame:
    return responses.export_documents(responses.curated_quizzes(data.responses(), stored=False))


def _saved(data: QuizData) -> str:
    """The store that a save of all curated responses, named by its run, leaves."""
    data = data.with_stored_lines()
    asked = data.questions().join(
        data.quizzes().select("quiz_id", "user_id", "module_id", "difficulty"), "quiz_id"
    ).select(F.col("question_id").alias("request_id"), "user_id", "module_id", "question_text", "difficulty")
    # Dealt out before the text becomes a hash, which is longer and does not compress.
    requests = asked.repartition("request_id").select(
        "request_id", "user_id", "module_id", fingerprint(F.col("question_text")).alias("notes_hash"), "difficulty"
    )
    new = quizzes_from_responses(data.responses(), requests, RUN_TIME, data.quizzes(), data.questions())
    root = scratch_path(data.spark, "store")
    tables.commit_quizzes(new.quizzes, new.questions, root, "curated")
    return root


@_query
def saved_quizzes(data: QuizData) -> DataFrame:
    return tables.read_committed(data.spark, _saved(data), "quizzes")


@_query
def saved_questions(data: QuizData) -> DataFrame:
    saved = tables.read_committed(data.spark, _saved(data), "questions")
    return saved.withColumn("options", F.to_json("options"))


# --- the submission feed ------------------------------------------------------------------------


def _events(data: QuizData) -> DataFrame:
    given = F.map_from_entries(F.collect_list(F.struct("question_id", "choice")))
    return (
        data.choices()
        .groupBy("submission_id", "user_id", "module_id", "quiz_id", "submitted_at")
        .agg(given.alias("choices"))
    )


def _fed(data: QuizData, events: DataFrame, on_missing: str) -> str:
    """The folder of what the feed makes of ``events`` against stored tables."""
    spark = data.spark
    root = scratch_path(spark, "submission-feed")
    events.write.parquet(f"{root}/events")
    known = _stored(data, data.quizzes(), "quizzes"), _stored(data, data.questions(), "questions")
    feed.start_scoring(
        feed.submission_stream(spark, f"{root}/events"),
        lambda: known,
        f"{root}/out",
        f"{root}/progress",
        on_missing=on_missing,
    ).awaitTermination()
    return f"{root}/out"


@_query
def streamed_attempts(data: QuizData) -> DataFrame:
    """All submissions written as a feed, scored by the stream against stored tables, read back."""
    data = data.with_stored_lines()
    out = _fed(data, _events(data), "wrong")
    return data.spark.read.parquet(f"{out}/performance").drop("batch")


@_query
def streamed_refusals(data: QuizData) -> DataFrame:
    """What the feed refuses: incomplete forms, and forms for quizzes that are not stored."""
    data = data.with_stored_lines()
    events = _events(data)
    lost = events.filter(F.col("quiz_id") % 5 == 0).withColumns(
        {"submission_id": -F.col("submission_id"), "quiz_id": -1 - F.col("quiz_id")}
    )
    out = _fed(data, events.unionByName(lost), "reject")
    return data.spark.read.parquet(f"{out}/refused").drop("batch")
