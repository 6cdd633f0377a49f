"""Exact top-k search and vector codes against plain Python, with ties, odd rows and empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake.llm import topk_search, vector_codes

KINDS = "vec_id long, embedding array<float>, label int"


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def whole(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def odd(rows):
    """Rows that take no part, repeated rows and ids, a null id and label, and columns with clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = rows + [(100, None, 1), (200, [nan] * 16, None), (7, [0.5] * 15 + [inf], 2), (8, [None] * 16, 3)]
    return rows + [rows[0], rows[0], (rows[1][0], rows[2][1], None), (None, rows[3][1], None), (None, rows[3][1], 4)]


def frame(spark, rows):
    out = spark.createDataFrame(rows, KINDS).repartition(3)
    for name in ("row", "v", "asked", "shard", "block", "part", "query", "rank", "score", "code", "same", "a.b"):
        out = out.withColumn(name, F.lit("x"))
    return out


def made(n, seed, size=16, step=0.25):
    """Coarse values, so that many scores and distances tie."""
    pick = random.Random(seed)
    return [(k, [pick.randrange(-4, 5) * step for _ in range(size)], pick.randrange(3)) for k in range(n)]


def best(rows, k):
    kept = [(i, vec_id, whole(v, 1024)) for i, (vec_id, v, _) in enumerate(rows) if usable(v)]
    out = []
    for i, query_id, q in kept:
        if query_id is not None and query_id % 5 == 0:
            others = [(-sum(a * b for a, b in zip(q, v)), vec_id is None, vec_id) for j, vec_id, v in kept if j != i]
            out += [(query_id, place + 1, vec_id, -score) for place, (score, _, vec_id) in enumerate(sorted(others, key=lambda o: (o[0], o[1], o[2] or 0))[:k])]
    return sorted(out, key=repr)


# Small shards and blocks, so that several meet; more parts than two as well.
@pytest.mark.parametrize("n,k,parts", [(150, 10, 2), (90, 3, 3), (6, 10, 2)])
def test_search_equals_brute_force(spark, n, k, parts):
    rows = odd(made(n, n))
    found = topk_search.search(frame(spark, rows), F.col("vec_id") % 5 == 0, k=k, parts=parts, shard_rows=40, block_queries=12)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(row) for row in found.collect()), key=repr) == best(rows, k)


def test_search_without_rows_or_queries(spark):
    assert topk_search.search(spark.createDataFrame([], KINDS), F.col("vec_id") % 5 == 0).count() == 0
    assert topk_search.search(spark.createDataFrame([(1, [1.0], 0), (2, [], 0)], KINDS), F.lit(False)).count() == 0
    short = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0], 0), (2, [], 0)], KINDS)
    found = topk_search.search(short, F.col("vec_id") == 0, scale=1).collect()
    assert [tuple(row) for row in found] == [(0, 1, 1, 3), (0, 2, 2, 0)]


def test_the_cutoff_prunes(spark):
    """Only entries that reach the share of the cutoff leave phase 2, and all that do."""
    import pyarrow as pa

    held = pa.table({"row": [1, 2, 3], "v": [[4], [1], [2]], "part": [0] * 3, "block": [0] * 3, "shard": [0] * 3})
    asked = pa.table({"row": [9], "v": [[1]], "part": [0], "block": [0], "shard": [0], "least": [1], "cutoff": [2]})
    found = topk_search._sufficient_entries(held, asked, parts=2, width=1).to_pylist()
    assert [(row["rows"], row["scores"]) for row in found] == [([1, 3], [4, 2])]


def coded(rows, parts=16, entries=64, rounds=2):
    kept = [(vec_id, whole(v, 256), label) for vec_id, v, label in rows if usable(v) and v]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for row in cut:
                members.setdefault(nearest(row[p], books[p])[1], []).append(row[p])
            for n, pieces in members.items():
                books[p][n] = [sum(axis) // len(pieces) for axis in zip(*pieces)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = [[nearest(row[p], books[p]) for p in range(parts)] for row in cut]
    errors = [sum(away for away, _ in row) for row in found]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    return sorted(
        ((vec_id, "".join(f"{n:02x}" for _, n in row), error, by_label[label], digest) for (vec_id, _, label), row, error in zip(kept, found, errors)),
        key=repr,
    )


@pytest.mark.parametrize("n,size,step", [(200, 32, 0.25), (70, 16, 0.01), (5, 64, 0.1)])
def test_codes_equal_plain_rounds(spark, n, size, step):
    rows = made(n, n, size, step)
    rows = odd(rows) if size == 16 else rows + [rows[0], (None, rows[1][1], None)]
    found = vector_codes.encode(frame(spark, rows))
    assert found.dtypes[:4] == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint")]
    assert sorted((tuple(row) for row in found.collect()), key=repr) == coded(rows)


def test_codes_of_no_rows_and_unlike_lengths(spark):
    assert vector_codes.encode(spark.createDataFrame([], KINDS)).count() == 0
    assert vector_codes.encode(spark.createDataFrame([(1, None, 1), (2, [], 1)], KINDS)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.encode(spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], KINDS))
    with pytest.raises(ValueError):
        vector_codes.encode(spark.createDataFrame([(1, [1.0] * 15, 1)], KINDS))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 12), st.integers(1, 70), st.integers(1, 200), st.integers(0, 10**6))
def test_two_trees_assign_as_one_by_one(n, axes, entries, spread, seed):
    pick = np.random.default_rng(seed)
    points, book = pick.integers(-spread, spread, (n, axes)), pick.integers(-spread, spread, (entries, axes))
    chosen, sums, counts, _ = vector_codes.assign(points, vector_codes.Codebook(book), entries)
    expected = ((points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    totals = np.zeros_like(book)
    np.add.at(totals, expected, points)
    assert (chosen == expected).all() and (sums == totals).all()
    assert (counts == np.bincount(expected, minlength=entries)).all()


def test_groups_are_assigned_without_distances():
    pick = np.random.default_rng(3)
    centers = np.arange(64)[:, None] * 1000 + np.zeros(4, np.int64)
    points = centers[pick.integers(0, 64, 20_000)] + pick.integers(-20, 20, (20_000, 4))
    *_, settled = vector_codes.assign(points, vector_codes.Codebook(centers), 64)
    assert settled < 0.01 * 64 * len(points)
