"""Types of the six quiz tables and of the shapes that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, STR, DBL, TS = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.DoubleType(),
    T.TimestampNTZType(),
)


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


USERS = _table(
    ("user_id", LONG),
    ("username", STR),
    ("email", STR),
    ("salt", STR),
    ("password_hash", STR),
    ("created_at", TS),
    ("email_verified", INT),
)
MODULES = _table(
    ("module_id", LONG), ("user_id", LONG), ("module_name", STR), ("created_at", TS)
)
QUIZZES = _table(
    ("quiz_id", LONG),
    ("user_id", LONG),
    ("module_id", LONG),
    ("timestamp", TS),
    ("notes_hash", STR),
    ("difficulty", STR),
)
QUESTIONS = _table(
    ("question_id", LONG),
    ("quiz_id", LONG),
    ("question_text", STR),
    ("options", T.ArrayType(STR)),
    ("correct_answer", INT),
    ("explanation", STR),
)
USER_ANSWERS = _table(
    ("answer_id", LONG),
    ("user_id", LONG),
    ("quiz_id", LONG),
    ("question_id", LONG),
    ("user_answer", INT),
    ("is_correct", INT),
)
PERFORMANCE = _table(
    ("performance_id", LONG),
    ("user_id", LONG),
    ("module_id", LONG),
    ("timestamp", TS),
    ("score", LONG),
    ("total", LONG),
    ("percentage", DBL),
)

TABLES = {
    "users": USERS,
    "modules": MODULES,
    "quizzes": QUIZZES,
    "questions": QUESTIONS,
    "user_answers": USER_ANSWERS,
    "performance": PERFORMANCE,
}

# (child table, child key, foreign key column, parent table, parent key column)
FOREIGN_KEYS = [
    ("modules", "module_id", "user_id", "users", "user_id"),
    ("quizzes", "quiz_id", "user_id", "users", "user_id"),
    ("quizzes", "quiz_id", "module_id", "modules", "module_id"),
    ("questions", "question_id", "quiz_id", "quizzes", "quiz_id"),
    ("user_answers", "answer_id", "user_id", "users", "user_id"),
    ("user_answers", "answer_id", "quiz_id", "quizzes", "quiz_id"),
    ("user_answers", "answer_id", "question_id", "questions", "question_id"),
    ("performance", "performance_id", "user_id", "users", "user_id"),
    ("performance", "performance_id", "module_id", "modules", "module_id"),
]

# One submitted quiz form; a null choice is a question left open.
SUBMISSION_EVENTS = _table(
    ("submission_id", LONG),
    ("user_id", LONG),
    ("module_id", LONG),
    ("quiz_id", LONG),
    ("submitted_at", TS),
    ("choices", T.MapType(LONG, INT)),
)

RESPONSES = _table(("request_id", LONG), ("attempt", INT), ("raw_text", STR))
