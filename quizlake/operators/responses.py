"""Curating model responses: ``responses`` has request_id, attempt, raw_text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions import quiz_json
from quizlake.session import store_bucketed

# Fixed values.
MAX_ATTEMPTS = 3
READY, FAILED = "ready", "failed"

_DUPLICATES = "spark.sql.variant.allowDuplicateKeys"
_WIDE = 1 << 32


def _judged(responses: DataFrame) -> DataFrame:
    """Status of every attempt, and its sealed document as ``_sealed``."""
    if responses.sparkSession.conf.get(_DUPLICATES, "false") != "true":
        raise RuntimeError(f"set {_DUPLICATES} to true: the last of duplicate keys counts")
    status = (
        F.when(~quiz_json.is_json(F.col("_sealed")), quiz_json.INVALID_JSON)
        .when(~F.col("_valid"), quiz_json.INVALID_STRUCTURE)
        .otherwise(quiz_json.OK)
    )
    attempt = ["request_id", "attempt"]
    # One select per step: a text used several times is computed once.
    return (
        responses.select(*attempt, quiz_json.stripped(F.col("raw_text")).alias("_text"))
        .select(*attempt, quiz_json.without_leading_fence(F.col("_text")).alias("_open"))
        .select(*attempt, quiz_json.without_trailing_fence(F.col("_open")).alias("_body"))
        .select(*attempt, quiz_json.outer_object(F.col("_body")).alias("_document"))
        .select(*attempt, quiz_json.sealed_parse(F.col("_document")).alias("_sealed"))
        .withColumn("_items", quiz_json.raw_items(F.col("_sealed")))
        .withColumn("_valid", quiz_json.items_valid(F.col("_items")))
        .select(*attempt, status.alias("status"), "_sealed")
    )


def judge_responses(responses: DataFrame) -> DataFrame:
    """Status, message and, if ok, the normalised questions and whole document of every attempt."""
    usable = F.col("status") == quiz_json.OK
    message = F.when(
        F.col("status") == quiz_json.INVALID_JSON, quiz_json.MESSAGES[quiz_json.INVALID_JSON]
    ).when(
        F.col("status") == quiz_json.INVALID_STRUCTURE,
        quiz_json.MESSAGES[quiz_json.INVALID_STRUCTURE],
    )
    return _judged(responses).select(
        "request_id",
        "attempt",
        "status",
        message.alias("message"),
        F.when(usable, quiz_json.normalised_items(F.col("_sealed"))).alias("questions"),
        F.when(usable, quiz_json.whole_document(F.col("_sealed"))).alias("generated"),
    )


def first_valid(judged: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per request: the first valid attempt of the first ``max_attempts``, or a failure.

    Only numbers are aggregated: an attempt together with its count of questions, or with its
    kind of error, in one long. The payload stays out of the shuffle; ``curated_quizzes``
    fetches it for the winners.
    """
    usable = F.col("status") == quiz_json.OK
    attempt = F.col("attempt").cast("bigint") * _WIDE
    bad_structure = (F.col("status") == quiz_json.INVALID_STRUCTURE).cast("bigint")
    chosen = F.min(F.when(usable, attempt + F.size("questions")))
    last_error = F.max(F.when(~usable, attempt + bad_structure))
    message = F.when(F.col("_error") % _WIDE == 1, quiz_json.MESSAGES[quiz_json.INVALID_STRUCTURE]).otherwise(
        quiz_json.MESSAGES[quiz_json.INVALID_JSON]
    )
    failed = F.col("_chosen").isNull()
    return (
        judged.filter(F.col("attempt") <= max_attempts)
        .groupBy("request_id")
        .agg(chosen.alias("_chosen"), last_error.alias("_error"))
        .select(
            "request_id",
            F.when(failed, FAILED).otherwise(READY).alias("status"),
            F.floor(F.col("_chosen") / _WIDE).cast("int").alias("attempt"),
            F.when(failed, F.concat(F.lit(f"Failed after {max_attempts} attempts: "), message)).alias("error"),
            (F.col("_chosen") % _WIDE).cast("int").alias("n_questions"),
        )
    )


def judged_payloads(responses: DataFrame, max_attempts: int = MAX_ATTEMPTS, whole: bool = True) -> DataFrame:
    """What is stored of every attempt that counts: its status, and of a usable one its questions.

    Nothing is filtered by the status here. Such a filter would be pushed below the steps of the
    parse and repeat them in its condition, so a text would be parsed once per mention.
    """
    judged = judge_responses(responses.filter(F.col("attempt") <= max_attempts))
    return judged.select("request_id", "attempt", "status", "questions", *(["generated"] if whole else []))


def curated_quizzes(
    responses: DataFrame, max_attempts: int = MAX_ATTEMPTS, whole: bool = True, stored: bool = True
) -> DataFrame:
    """request_id, attempt, questions, n_questions of every request that got a valid quiz, and ``generated`` if ``whole``.

    Every attempt is parsed once and dealt out once, by its request, as raw text: the exchange keeps the
    parse apart from the making of the texts, as code of both together can be too long to be compiled.
    The winner is the attempt that ``first_valid`` chooses: it is compared behind the parse by a window,
    so no filter gets below it, and only winners become texts.
    Winners are stored in buckets of their request, so that readers neither parse nor deal out again;
    a single reader does without by ``stored`` false, which writes nothing and stays lazy.
    ``generated`` is the whole document as a Variant, which only the export needs.
    """
    tasks = int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = responses.filter(F.col("request_id").isNotNull() & (F.col("attempt") <= max_attempts))
    judged = _judged(counted.repartition(tasks, "request_id"))
    usable = F.when(F.col("status") == quiz_json.OK, F.col("attempt"))
    chosen = F.min(usable).over(Window.partitionBy("request_id"))
    winners = judged.withColumn("_chosen", chosen).filter(
        (F.col("attempt") == F.col("_chosen")) & F.col("status").eqNullSafe(quiz_json.OK)
    )
    questions = quiz_json.normalised_items(F.col("_sealed")).alias("questions")
    generated = quiz_json.whole_document(F.col("_sealed")).alias("generated")
    winners = winners.select("request_id", "attempt", questions, *([generated] if whole else []))
    winners = winners.withColumn("n_questions", F.size("questions"))
    return store_bucketed(winners, "curated", "request_id") if stored else winners


def curated_questions(curated: DataFrame) -> DataFrame:
    """One row per generated question, list order kept as position from 0."""
    # The outer form: for the inner one Spark asks beforehand for the list's size, which makes the list twice.
    listed = curated.select("request_id", F.posexplode_outer("questions").alias("position", "q"))
    return listed.filter(F.col("position").isNotNull()).select("request_id", "position", "q.*")


def export_documents(curated: DataFrame, pretty: bool = False) -> DataFrame:
    """The downloadable JSON document of each generated quiz: no ids, as generated.

    Other keys and the types of values stay; an answer is a number and an explanation is there.
    A document comes from one response cell, so no grouping is needed to rebuild it.
    """
    document = quiz_json.generated_json(F.col("generated"), F.col("questions"), pretty)
    return curated.select("request_id", document.alias("document"))


def export_files(documents: DataFrame, headers: DataFrame) -> DataFrame:
    """The documents under the file names of the quizzes they were saved as."""
    name = F.concat(F.lit("quiz_"), F.col("quiz_id").cast("string"), F.lit(".json"))
    return documents.join(headers.select("request_id", "quiz_id"), "request_id").select(
        name.alias("file_name"), "document"
    )
