"""Notes: parts to text, quality gate, fingerprint, preview and generation prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions.text import (
    PROMPT_CHARS,
    fingerprint,
    preview,
    strip,
    strip_left,
    strip_or_empty,
    strip_right,
    thousands,
)

# Fixed values.
PDF, DOCX, RTF, ODT, PPTX, TEXT = "pdf", "docx", "rtf", "odt", "pptx", "text"
PDF_MIN_CHARS = 50
OK, EMPTY, SCANNED, FAILED = "ok", "empty", "scanned_or_empty", "extraction_error"
GATE_MESSAGES = {
    SCANNED: "PDF appears to be scanned or empty. Please use a text-based PDF.",
    EMPTY: "No text could be extracted. Please check your file.",
}
EXTRACTION_ERROR_PREFIX = "Error extracting text: "

# Request settings and the prompt sent to the model.
MIN_QUESTIONS, MAX_QUESTIONS, DEFAULT_QUESTIONS = 1, 50, 10
DIFFICULTIES = ["Easy", "Medium", "Hard"]
DEFAULT_DIFFICULTY = "Medium"
PROMPT_TEMPLATE = """You are an expert quiz generator. Create {num_questions} multiple-choice questions based ONLY on the provided notes.

Difficulty level: {difficulty}

Return ONLY valid JSON in this exact format (no markdown, no extra text):
{"questions": [{"question":"Question text here","options":["Option A","Option B","Option C","Option D"],"answer":0,"explanation":"Brief explanation"}]}

Rules:
- "answer" must be 0, 1, 2, or 3 (index of correct option)
- Include exactly 4 options per question
- Keep explanations brief and clear
- Base questions only on the provided notes

NOTES:
{notes}
"""

# Pieces that the parts of a note are dealt into before its head is picked.
PIECES = 64


def note_route(file_name: Column) -> Column:
    """Which extractor a file goes to, by lower-cased extension; anything unknown is text."""
    name = F.lower(file_name)
    route = F.when(F.endswith(name, F.lit(".pdf")), PDF)
    for extension in (DOCX, RTF, ODT, PPTX):
        route = route.when(F.endswith(name, F.lit("." + extension)), extension)
    return route.otherwise(TEXT)


def assemble_notes(parts: DataFrame) -> DataFrame:
    """Parts (note_id, part_no, text) to one text a note: joined by line feeds in order, stripped.

    (note_id, part_no) is unique. A note is one cell, as every reader of it needs it whole.
    """
    in_order = F.array_sort(
        F.collect_list(F.struct("part_no", F.coalesce("text", F.lit("")).alias("text")))
    )
    return (
        parts.groupBy("note_id")
        .agg(in_order.alias("_parts"))
        .select("note_id", strip(F.array_join(F.col("_parts.text"), "\n")).alias("text"))
    )


def note_heads(parts: DataFrame, limit: int = PROMPT_CHARS) -> DataFrame:
    """The first ``limit`` characters of every assembled note, and the length of the whole: note_id, text, n_chars.

    The same as ``assemble_notes`` cut short, for readers that need no more, without the whole note in a
    cell. Blanks at the note's ends are stripped, so it begins in its first part that is not
    blank and ends in its last; its length is a sum over the parts between. Every part brings a
    character at least, the line feed before the next, so only the first ``limit`` + 1 of them can matter:
    they are picked within salted pieces of a note first, then by a running length over what is left,
    at most so many parts a piece.
    """
    part = F.coalesce(F.col("text"), F.lit("")).alias("text")
    size = F.length("text")
    lead, trail = size - F.length(strip_left(F.col("text"))), size - F.length(strip_right(F.col("text")))
    measured = parts.select("note_id", "part_no", part).withColumns(
        {"size": size.cast("bigint"), "blank": strip(F.col("text")) == ""}
    )
    ends = measured.groupBy("note_id").agg(
        F.min(F.when(~F.col("blank"), F.struct("part_no", lead.alias("cut")))).alias("first"),
        F.max(F.when(~F.col("blank"), F.struct("part_no", trail.alias("cut")))).alias("last"),
    )
    # A note's ends meet its parts in a join, which AQE cuts for a note of very many parts.
    inside = measured.join(ends.filter(F.col("first").isNotNull()), "note_id").filter(
        F.col("part_no").between(F.col("first.part_no"), F.col("last.part_no"))
    )
    lengths = inside.groupBy("note_id", "first", "last").agg(
        (F.sum(F.col("size") + 1) - 1).alias("n_chars")
    ).select("note_id", (F.col("n_chars") - F.col("first.cut") - F.col("last.cut")).alias("n_chars"))
    in_piece = Window.partitionBy("note_id", "piece").orderBy("part_no")
    in_order = Window.partitionBy("note_id").orderBy("part_no")
    before = F.sum(F.col("size") + 1).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    # What the blanks in front take away is read on top of the limit.
    heads = (
        inside.select("note_id", "part_no", "size", F.col("first.cut").alias("cut"), "text")
        .withColumn("piece", F.pmod("part_no", F.lit(PIECES)))
        .repartition("note_id", "piece")  # or a window would stay where the join left the whole note
        .withColumn("place", F.row_number().over(in_piece))
        .filter(F.col("place") <= limit + 1)
        .withColumn("room", limit + F.col("cut") - F.coalesce(before, F.lit(0)))
        .filter(F.col("room") >= 0)  # one that begins just behind the limit still brings its line feed
        .select("note_id", F.struct("part_no", F.substring(F.col("text"), F.lit(1), F.least("room", "size").cast("int")).alias("text")).alias("part"))
        .groupBy("note_id")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select("note_id", F.array_join(F.col("parts.text"), "\n").alias("text"))
    )
    shown = F.substring(strip_left(F.coalesce("text", F.lit(""))), 1, limit)
    # The end of a note is stripped where it is in sight.
    whole = F.coalesce("n_chars", F.lit(0).cast("bigint"))
    found = ends.select("note_id").join(lengths, "note_id", "left").join(heads, "note_id", "left")
    return found.select(
        "note_id", F.substring(shown, F.lit(1), F.least(whole, F.lit(limit)).cast("int")).alias("text"), whole.alias("n_chars")
    )


def gate_notes(notes: DataFrame) -> DataFrame:
    """Route, cleaned text, status and message per note; nothing is dropped.

    ``notes`` has note_id, file_name, text and, if an extractor ran, extract_error. Where it has n_chars,
    text may be the head of a cleaned note of that length.
    """
    whole = F.col("n_chars") if "n_chars" in notes.columns else F.lit(None).cast("bigint")
    error = F.col("extract_error") if "extract_error" in notes.columns else F.lit(None).cast("string")
    status = (
        F.when(error.isNotNull(), FAILED)
        .when((F.col("route") == PDF) & (F.coalesce("n_chars", F.length("text")) < PDF_MIN_CHARS), SCANNED)
        .when(F.col("text") == "", EMPTY)
        .otherwise(OK)
    )
    return (
        notes.select(
            "note_id",
            "file_name",
            note_route(F.col("file_name")).alias("route"),
            # A head is clean already, and what it ends in may be the middle of its note.
            F.when(whole.isNotNull(), F.col("text")).otherwise(strip_or_empty(F.col("text"))).alias("text"),
            error.alias("extract_error"),
            whole.alias("n_chars"),
        )
        .withColumn("status", status)
        .select(
            "note_id",
            "file_name",
            "route",
            F.when(F.col("status") == OK, F.col("text")).otherwise("").alias("text"),
            "status",
            F.when(
                F.col("status") == FAILED,
                F.concat(F.lit(EXTRACTION_ERROR_PREFIX), F.col("extract_error")),
            )
            .when(F.col("status") == SCANNED, GATE_MESSAGES[SCANNED])
            .when(F.col("status") == EMPTY, GATE_MESSAGES[EMPTY])
            .alias("message"),
        )
    )


def accepted_notes(gated: DataFrame) -> DataFrame:
    return gated.filter(F.col("status") == OK).drop("status", "message")


def quarantined_notes(gated: DataFrame) -> DataFrame:
    return gated.filter(F.col("status") != OK).select(
        "note_id", "file_name", "route", "status", "message"
    )


def fingerprint_notes(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", fingerprint(F.col("text")).alias("notes_hash"))


def duplicate_notes(notes: DataFrame) -> DataFrame:
    """Every note with the smallest id of the notes of the same text, and how many they are.

    Ids are counted by fingerprint before the shuffle; texts do not travel, and the notes of a text that
    a third of all share meet a table of one row per fingerprint, a join that AQE cuts.
    """
    marked = fingerprint_notes(notes)
    groups = marked.groupBy("notes_hash").agg(F.min("note_id").alias("first_note_id"), F.count("*").alias("copies"))
    return marked.join(groups, "notes_hash").select("note_id", "first_note_id", "copies")


def preview_notes(notes: DataFrame) -> DataFrame:
    size = F.length("text")
    return notes.select(
        "note_id",
        size.cast("bigint").alias("n_chars"),
        preview(F.col("text")).alias("preview"),
        F.concat(F.lit("Total: "), thousands(size), F.lit(" characters")).alias("caption"),
    )


def prompt_text(notes_text: Column, num_questions: Column, difficulty: Column) -> Column:
    head, rest = PROMPT_TEMPLATE.split("{num_questions}")
    middle, rest = rest.split("{difficulty}")
    rules, tail = rest.split("{notes}")
    return F.concat(
        F.lit(head),
        num_questions.cast("string"),
        F.lit(middle),
        difficulty,
        F.lit(rules),
        F.substring(notes_text, 1, PROMPT_CHARS),
        F.lit(tail),
    )


def build_prompts(requests: DataFrame) -> DataFrame:
    """Prompts for requests (note_id, text, num_questions, difficulty); null settings default.

    Settings outside the offered range are flagged and get no prompt.
    """
    in_range = F.col("num_questions").between(MIN_QUESTIONS, MAX_QUESTIONS) & F.col(
        "difficulty"
    ).isin(DIFFICULTIES)
    prompt = prompt_text(F.col("text"), F.col("num_questions"), F.col("difficulty"))
    return (
        requests.withColumns(
            {
                "num_questions": F.coalesce("num_questions", F.lit(DEFAULT_QUESTIONS)),
                "difficulty": F.coalesce("difficulty", F.lit(DEFAULT_DIFFICULTY)),
            }
        )
        .withColumn("settings_ok", in_range)
        .select(
            "note_id",
            "num_questions",
            "difficulty",
            "settings_ok",
            F.when(F.col("settings_ok"), prompt).alias("prompt"),
        )
    )
