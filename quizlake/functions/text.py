"""Text expressions. All are JVM-side columns; none leaves whole-stage codegen."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes. Spark's trim() removes the
# space only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed values.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PREVIEW_CHARS = 1500
PROMPT_CHARS = 4000


def strip(text: Column) -> Column:
    """Both ends cleared of Unicode whitespace; interior runs cost nothing extra."""
    return F.btrim(text, F.lit(WHITESPACE))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def strip_or_empty(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only, as a SQL LOWER without Unicode support does."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fingerprint(text: Column) -> Column:
    """SHA-256 hex of the UTF-8 bytes."""
    return F.sha2(text, 256)


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    more = F.when(F.length(text) > chars, F.lit("...")).otherwise(F.lit(""))
    return F.concat(F.substring(text, 1, chars), more)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL_PATTERN)


def iso_seconds(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def iso_minutes(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm")


def one_decimal(value: Column) -> Column:
    """``value`` in 0..100 with one decimal, rounded half-even on the exact binary value.

    format_string and round go half-up, bround goes by the shortest decimal form; both
    differ from correct rounding (6.25 -> 6.2, 0.35 -> 0.3). A double times a power of two
    is exact, so the rounding is done on integers.
    """
    bits = F.when(value < 0.25, F.lit(57)).otherwise(F.lit(54))
    unit = F.pow(F.lit(2.0), bits)
    tenfold = (value * unit).cast("bigint").cast("decimal(20,0)") * F.lit(10).cast("decimal(2,0)")
    whole = unit.cast("bigint").cast("decimal(20,0)")
    rest = tenfold % whole
    floor = ((tenfold - rest) / whole).cast("bigint")
    twice = rest * F.lit(2).cast("decimal(1,0)")
    up = (twice > whole) | ((twice == whole) & (floor % 2 == 1))
    tenths = floor + up.cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def percent_text(value: Column) -> Column:
    return F.concat(one_decimal(value), F.lit("%"))
