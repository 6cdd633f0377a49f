import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake.functions import text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, expression, kind="string"):
    rows = column(spark, values, kind).select("i", expression.alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_strip_equals_python(spark):
    spaces = [chr(c) for c in range(0x3001) if not chr(c).strip() and chr(c)]
    values = ["", " ", "a", " a b ", "​a​", "﻿x"]
    values += [f"{s}x{s}y{s}" for s in spaces] + ["".join(spaces)]
    assert apply(spark, values, text.strip(F.col("v"))) == [v.strip() for v in values]
    assert apply(spark, values, text.strip_left(F.col("v"))) == [v.lstrip() for v in values]
    assert apply(spark, values, text.strip_right(F.col("v"))) == [v.rstrip() for v in values]


def test_strip_or_empty_of_null(spark):
    assert apply(spark, [None, " a "], text.strip_or_empty(F.col("v"))) == ["", "a"]


def test_ascii_lower_leaves_other_letters(spark):
    assert apply(spark, ["ABCé", "É", "Zz"], text.ascii_lower(F.col("v"))) == ["abcé", "É", "zz"]


def test_one_decimal_equals_python(spark):
    random.seed(7)
    values = [s / t * 100 for t in range(1, 65) for s in range(t + 1)]
    values += [k / 20 for k in range(2001)] + [k / 8 for k in range(801)]
    values += [random.uniform(0, 100) for _ in range(3000)]
    values += [random.uniform(0, 0.3) for _ in range(500)] + [5e-324, 0.05, 0.15, 0.25, 99.95]
    got = apply(spark, values, text.one_decimal(F.col("v")), "double")
    assert got == [f"{v:.1f}" for v in values]


def test_preview_counts_code_points(spark):
    values = ["é" * 1500, "😀" * 1501, "short"]
    assert apply(spark, values, text.preview(F.col("v"))) == [
        v[:1500] + ("..." if len(v) > 1500 else "") for v in values
    ]


def test_thousands(spark):
    values = [0, 999, 1000, 1234567]
    assert apply(spark, values, text.thousands(F.col("v")), "bigint") == [f"{v:,}" for v in values]


@pytest.mark.parametrize(
    ("address", "accepted"),
    [
        ("a@b.co", True),
        ("a.b+c%d@x-y.z.org", True),
        ("a@b", False),
        ("a@b.c", False),
        ("@b.co", False),
        ("a b@c.co", False),
        ("a@b.co\nx", False),
        ("ä@b.co", False),
        ("a@b.c0", False),
    ],
)
def test_email(spark, address, accepted):
    assert apply(spark, [address], text.is_email(F.col("v"))) == [accepted]


def test_fingerprint(spark):
    import hashlib

    values = ["", "é", "notes"]
    assert apply(spark, values, text.fingerprint(F.col("v"))) == [
        hashlib.sha256(v.encode()).hexdigest() for v in values
    ]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_strip_property(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    assert apply(spark, values, text.strip(F.col("v"))) == [v.strip() for v in values]
