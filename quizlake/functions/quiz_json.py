"""Raw model text -> strict JSON -> validated, normalised question array.

Everything is a Variant expression; no Python runs. The session must have
``spark.sql.variant.allowDuplicateKeys`` on (the last duplicate wins), see session.configure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizlake.functions.text import strip_left, strip_or_empty, strip_right

# The outcome of one attempt and the messages that go with it.
OK = "ok"
INVALID_JSON = "invalid_json"
INVALID_STRUCTURE = "invalid_structure"
MESSAGES = {
    INVALID_JSON: "Invalid JSON from model",
    INVALID_STRUCTURE: "Model returned invalid quiz structure",
}
OPTIONS_PER_QUESTION = 4
LAST_OPTION = OPTIONS_PER_QUESTION - 1

_FENCE = "```"
_TAGGED_FENCE = _FENCE + "json"

# One cast reads the whole list: a member that does not fit its type becomes null, a missing
# key becomes null, and a JSON null of a variant member stays distinguishable from a missing
# one. answer takes the integer rules of a lenient int(): 2.9 -> 2, " 2 " -> 2, true -> 1.
# A value that turns into text or a number costs far more than one that does not: of the options
# the judgement reads only how many there are, each as an object that it need not be.
_RAW_ITEMS = (
    "array<struct<question:variant,options:array<struct<any:variant>>,answer:int>>"
)
_TEXT_ITEMS = "array<struct<question:string,options:array<string>,answer:int,explanation:variant>>"

# What Spark finds in a document of the known keys whose question, options and explanation are strings or
# null, with answers written as whole numbers: the normalised questions say all of it.
_PLAIN = [
    f"OBJECT<questions: ARRAY<OBJECT<answer: BIGINT, {explanation}options: ARRAY<STRING>, question: STRING>>>"
    for explanation in ("", "explanation: STRING, ", "explanation: VOID, ")
]

# Closes the probe array behind the document, see sealed_parse.
_SEAL = "quizlake-end-of-document"


def _after(text: Column, prefix: str) -> Column:
    return strip_left(F.substring(text, F.lit(len(prefix) + 1), F.length(text)))


def stripped(text: Column) -> Column:
    """Text without blanks at its ends, '' for null. What begins and ends in a brace has none to look for."""
    is_span = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    return F.when(is_span, text).otherwise(strip_or_empty(text))


def without_leading_fence(text: Column) -> Column:
    """Text, already trimmed, without one opening code fence, tagged json or untagged."""
    return (
        F.when(F.startswith(text, F.lit(_TAGGED_FENCE)), _after(text, _TAGGED_FENCE))
        .when(F.startswith(text, F.lit(_FENCE)), _after(text, _FENCE))
        .otherwise(text)
    )


def without_trailing_fence(text: Column) -> Column:
    """Text, already trimmed, without one closing code fence."""
    kept = F.substring(text, F.lit(1), F.length(text) - len(_FENCE))
    return F.when(F.endswith(text, F.lit(_FENCE)), strip_right(kept)).otherwise(text)


def outer_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; the whole text when there is no such span."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    is_span = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    has_span = F.contains(text, F.lit("}")) & (first > 0) & (last > first)
    return (
        F.when(is_span, text)
        .when(has_span, F.substring(text, first, last - first + 1))
        .otherwise(text)
    )


def sealed_parse(document: Column) -> Column:
    """``[document, seal]`` as a Variant, or null.

    try_parse_json stops at the end of the first value and ignores the rest. Parsed as the
    first member of a two-member array, a document with anything behind its value either
    fails or moves the second member. A text that holds the seal itself is first checked in
    two wrappings no such text can satisfy both of.
    """
    sealed = F.concat(F.lit("["), document, F.lit(f',"{_SEAL}"]'))
    as_member = F.try_parse_json(F.concat(F.lit("["), document, F.lit("]")))
    as_value = F.try_parse_json(F.concat(F.lit('{"w":'), document, F.lit("}")))
    single = ~F.contains(document, F.lit(_SEAL)) | (as_member.isNotNull() & as_value.isNotNull())
    return F.when(single, F.try_parse_json(sealed))


def is_json(sealed: Column) -> Column:
    """Whether the sealed document is one JSON value and nothing more."""
    return F.coalesce(F.try_variant_get(sealed, "$[1]", "string") == _SEAL, F.lit(False))


def raw_items(sealed: Column) -> Column:
    """The list under "questions" of the sealed document, null when there is no such list."""
    return F.try_variant_get(sealed, "$[0].questions", _RAW_ITEMS)


def items_valid(items: Column) -> Column:
    """A list, possibly empty, in which every item has the required keys and shapes."""

    def item_valid(item: Column) -> Column:
        return F.coalesce(
            item["question"].isNotNull()
            & (F.size(item["options"]) == OPTIONS_PER_QUESTION)
            & item["answer"].between(0, LAST_OPTION),
            F.lit(False),
        )

    return items.isNotNull() & F.coalesce(F.forall(items, item_valid), F.lit(False))


def normalised_items(sealed: Column) -> Column:
    """Question structs of a list that ``items_valid`` accepts; an absent explanation becomes '', a null one stays null."""
    return F.transform(
        F.try_variant_get(sealed, "$[0].questions", _TEXT_ITEMS),
        lambda item: F.struct(
            item["question"].alias("question"),
            item["options"].alias("options"),
            item["answer"].alias("answer"),
            F.when(item["explanation"].isNull(), F.lit(""))
            .otherwise(item["explanation"].cast("string"))
            .alias("explanation"),
        ),
    )


def whole_document(sealed: Column) -> Column:
    """The sealed document itself as a Variant, with every key and value type."""
    return F.try_variant_get(sealed, "$[0]", "variant")


def generated_json(document: Column, questions: Column, pretty: bool = False) -> Column:
    """The whole document as JSON text: answers as numbers, an absent explanation as ''.

    The known keys come first, others by name behind them, of an item and of the document. A Variant writes
    each string at the cost of a new JSON writer, so a plain document is written from its questions.
    """
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    known = ["question", "options", "answer", "explanation"]
    top = F.try_variant_get(document, "$", "map<string,variant>")
    items = F.try_variant_get(document, "$.questions", "array<map<string,variant>>")
    variant = lambda column: F.to_variant_object(F.array(column))
    first = lambda column: F.variant_get(variant(column), "$[0]", "variant")

    def whole(item: Column, question: Column) -> Column:
        values = F.array(
            item["question"],
            item["options"],
            first(question["answer"]),
            F.coalesce(item["explanation"], first(F.lit(""))),
        )
        others = F.map_filter(item, lambda key, _: ~key.isin(known))
        return F.map_concat(F.map_from_arrays(F.array(*map(F.lit, known)), values), others)

    text = F.to_json(F.struct(F.zip_with(items, questions, whole).alias("questions")), options)
    others = F.map_filter(top, lambda key, _: key != "questions")
    # Without the brace, and the line feed before it, that ends the text.
    open_text = F.substring(text, F.lit(1), F.length(text) - (2 if pretty else 1))
    joined = F.concat(open_text, F.lit(","), F.substring(F.to_json(others, options), 2, 2**31 - 1))
    written = F.when(F.size(others) == 0, text).otherwise(joined)
    if pretty:  # a Variant's list stays in one line
        return written
    plain = F.to_json(F.struct(questions.alias("questions")), options)
    return F.when(F.schema_of_variant(document).isin(_PLAIN), plain).otherwise(written)


def decode_options(options_json: Column) -> Column:
    return F.from_json(options_json, "array<string>")


def encode_options(options: Column) -> Column:
    return F.to_json(options)
