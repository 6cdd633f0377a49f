"""The three user journeys, each for all users at once: generate, take, progress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quizlake.operators import catalog, notes, progress, responses, scoring, store
from quizlake.session import store_bucketed


def prompts_from_parts(parts: DataFrame, files: DataFrame, settings: DataFrame) -> DataFrame:
    """Note parts to prompts: head of the note, gate, join the request settings, fill the template.

    ``files`` has note_id and file_name, ``settings`` note_id, num_questions and difficulty. A prompt
    shows a note's head only, so no note is put together whole.
    """
    gated = notes.gate_notes(files.join(notes.note_heads(parts), "note_id"))
    return notes.build_prompts(notes.accepted_notes(gated).join(settings, "note_id"))


@dataclass
class SavedQuizzes:
    quizzes: DataFrame
    questions: DataFrame


def quizzes_from_responses(
    raw: DataFrame,
    requests: DataFrame,
    run_time: str,
    quizzes: DataFrame | None = None,
    questions: DataFrame | None = None,
) -> SavedQuizzes:
    """Raw responses to new rows of quizzes and questions, both from one stored curated set."""
    curated = responses.curated_quizzes(raw, whole=False)
    ids = store_bucketed(store.quiz_ids(curated, quizzes, questions), "quiz-ids", "request_id")
    headers = store.quiz_headers(curated, requests, quizzes, run_time, questions, ids)
    return SavedQuizzes(headers, store.question_rows(curated, headers, questions, ids))


@dataclass
class ScoredSubmissions:
    performance: DataFrame
    user_answers: DataFrame
    results: DataFrame
    review: DataFrame


def take_quizzes(
    submissions: DataFrame, choices: DataFrame, questions: DataFrame, on_missing: str = "reject"
) -> ScoredSubmissions:
    """Everything submitting a form produces, for all forms."""
    scored = scoring.score_submissions(submissions, choices, questions, on_missing)
    taken = submissions.join(scored.select("submission_id"), "submission_id", "left_semi")
    return ScoredSubmissions(
        performance=scoring.performance_rows(scored),
        user_answers=scoring.user_answer_rows(scoring.grade_answers(taken, choices, questions)),
        results=scoring.result_lines(scored),
        review=scoring.review_lines(taken, choices, catalog.number_questions(questions)),
    )


@dataclass
class Progress:
    summary: DataFrame
    trend: DataFrame
    history: DataFrame


def show_progress(performance: DataFrame) -> Progress:
    return Progress(
        progress.progress_summary(performance),
        progress.trend(performance),
        progress.history(performance).drop("place"),
    )
