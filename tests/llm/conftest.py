import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang)."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd_documents(spark, documents):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, clashing extra columns."""
    long = " ".join(f"word{k % 997}" for k in range(60_000))
    rows = [
        (None, None, None),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "same words in this line of some length, forty code points\nand more"),
        (4, "same words in this line of some length, forty code points\nand more"),
        (5, "Same words in this line of some length, forty code points"),
        (6, long, "de"),
        (7, "a  b c\n\nd İ \U0001f600 ́x <|endoftext|> it's 1d10t"),
        (8, "\x00\x01 control", None),
    ]
    frame = documents(*rows)
    for name in ("hash", "key", "row", "node", "rank", "place", "bands", "count", "words", "mark", "next", "copy", "kept"):
        frame = frame.selectExpr("*", f"'x' as `{name}`")
    return frame
