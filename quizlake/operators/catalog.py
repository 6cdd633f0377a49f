"""What a user finds in a module: lists, defaults, labels and whole quizzes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions.text import iso_seconds
from quizlake.operators.keys import number_within, rank_rows

# List lengths.
QUIZZES_LISTED = 50
MODULES_LISTED = 15

_QUESTION_LIST = (
    "array<struct<question_id:bigint,question:string,options:array<string>,"
    "answer:int,explanation:string>>"
)


def module_list(modules: DataFrame, user_id: int) -> DataFrame:
    """One user's modules by name (byte order)."""
    return (
        modules.filter(F.col("user_id") == user_id)
        .select("module_id", "module_name")
        .orderBy("module_name")
    )


def quiz_list(
    quizzes: DataFrame, user_id: int, module_id: int, limit: int = QUIZZES_LISTED
) -> DataFrame:
    """One module's newest quizzes."""
    return (
        quizzes.filter((F.col("user_id") == user_id) & (F.col("module_id") == module_id))
        .select("quiz_id", "timestamp", "difficulty")
        .orderBy(F.desc("quiz_id"))
        .limit(limit)
    )


def in_listed_order(listed: DataFrame, *order: str | Column) -> DataFrame:
    """A list that one user is shown, with every row's place in it from 1."""
    return rank_rows(listed, order, "place")


def latest_quizzes(quizzes: DataFrame, per_module: int = QUIZZES_LISTED) -> DataFrame:
    """The newest quizzes of every module, with their place in the list from 1.

    The rank limit is applied before the shuffle too, so a hot module sends at most
    ``per_module`` rows per task.
    """
    newest = Window.partitionBy("user_id", "module_id").orderBy(F.desc("quiz_id"))
    return (
        quizzes.select("user_id", "module_id", "quiz_id", "timestamp", "difficulty")
        .withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") <= per_module)
    )


def modules_per_user(modules: DataFrame, per_user: int = MODULES_LISTED) -> DataFrame:
    """The first modules of every user by name, with their place in the list from 1."""
    by_name = Window.partitionBy("user_id").orderBy("module_name")
    return (
        modules.select("user_id", "module_id", "module_name")
        .withColumn("place", F.row_number().over(by_name))
        .filter(F.col("place") <= per_user)
    )


def default_quizzes(
    quizzes: DataFrame, selections: DataFrame, per_module: int = QUIZZES_LISTED
) -> DataFrame:
    """The quiz a module opens with: the selected one if it is listed, else the newest.

    ``selections`` has user_id, module_id, selected_quiz_id, one row per module; modules
    without a selection open with the newest quiz.
    """
    module = ["user_id", "module_id"]
    listed = latest_quizzes(quizzes, per_module)
    newest = listed.filter(F.col("place") == 1).select(
        *module, F.col("quiz_id").alias("newest_quiz_id")
    )
    picked = (
        selections.withColumnRenamed("selected_quiz_id", "quiz_id")
        .join(listed.select(*module, "quiz_id"), [*module, "quiz_id"], "left_semi")
        .select(*module, F.col("quiz_id").alias("picked_quiz_id"))
    )
    return newest.join(picked, module, "left").select(
        *module, F.coalesce("picked_quiz_id", "newest_quiz_id").alias("quiz_id")
    )


def quiz_labels(quizzes: DataFrame) -> DataFrame:
    # Fixed values.
    label = F.concat(
        F.lit("Quiz #"),
        F.col("quiz_id").cast("string"),
        F.lit(" • "),
        iso_seconds(F.col("timestamp")),
        F.lit(" • "),
        F.col("difficulty"),
    )
    return quizzes.select("quiz_id", label.alias("label"))


def number_questions(questions: DataFrame) -> DataFrame:
    """Question numbers from 1 within each quiz, in id order."""
    return number_within(questions, "quiz_id", "question_id", "question_number")


def quiz_documents(quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    """Every quiz as one nested document, questions in id order; none is an empty list."""
    question = F.struct(
        F.col("question_id"),
        F.col("question_text").alias("question"),
        F.col("options"),
        F.col("correct_answer").alias("answer"),
        F.coalesce("explanation", F.lit("")).alias("explanation"),
    )
    listed = questions.groupBy("quiz_id").agg(
        F.array_sort(F.collect_list(question)).alias("questions")
    )
    no_questions = F.from_json(F.lit("[]"), _QUESTION_LIST)
    return (
        quizzes.select("quiz_id", "difficulty", "timestamp")
        .join(listed, "quiz_id", "left")
        .select(
            "quiz_id", "difficulty", "timestamp", F.coalesce("questions", no_questions).alias("questions")
        )
    )


def load_quiz(quizzes: DataFrame, questions: DataFrame, quiz_id: int) -> DataFrame:
    """One quiz as a nested document; no row for an unknown quiz. Both scans are filtered."""
    return quiz_documents(
        quizzes.filter(F.col("quiz_id") == quiz_id),
        questions.filter(F.col("quiz_id") == quiz_id),
    )
