"""Column expressions that several document operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six characters counted as blank.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def named(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others_of(docs: DataFrame, text: str) -> Column:
    """All columns but the text in one struct, where no name can clash."""
    fields = [named(name) for name in docs.columns if name != text]
    return F.struct(*fields).alias("others") if fields else F.lit(None).cast("int").alias("others")


def carried(docs: DataFrame, text: str, changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``docs`` again, from rows that carried ``text`` and ``others_of``; some may be ``changed``."""
    new = changed or {}

    def from_row(name: str) -> Column:
        return new[name] if name in new else F.col("text") if name == text else F.col("others").getField(name)

    return [from_row(name).alias(name) for name in docs.columns]


def text_of(name: str) -> Column:
    """The text, null counted as empty."""
    return F.coalesce(named(name).cast("string"), F.lit(""))


def without_blanks(text: Column) -> Column:
    """Every blank deleted. Plain replacement searches bytes, far cheaper than a pattern."""
    return reduce(lambda done, blank: F.replace(done, F.lit(blank), F.lit("")), BLANKS, text)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick path is for texts of ASCII alone."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
