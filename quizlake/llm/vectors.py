"""Vectors as whole numbers, stored once, for the operators that must be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.session import store_once

# Components beyond this would overflow sums of products in 64 bits.
_BITS = 26


def _finite(component: Column) -> Column:
    return component.isNotNull() & ~F.isnan(component) & (F.abs(component) < float("inf"))


def whole_vectors(rows: DataFrame, scale: int, columns: dict[str, str], embedding: str) -> DataFrame:
    """``columns`` (new name to column), row (a number of its own) and v, floor(scale * x) of every component x.

    Rows whose vector is null or holds a null or non-finite component are left out. A component
    beyond 2^26 after scaling is an error: sums of products of such would not fit a long. The
    table is stored, so that every reader sees one numbering of the rows.
    """
    name = lambda column: F.col(f"`{column}`")
    usable = F.forall(name(embedding), lambda x: F.coalesce(_finite(x.cast("double")), F.lit(False)))
    whole = lambda x: F.floor(x.cast("double") * scale)
    checked = lambda x: F.when(F.abs(x) <= 1 << _BITS, x.cast("int")).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond 2^{_BITS}")).cast("int")
    )
    vector = F.when(usable, F.transform(F.transform(name(embedding), whole), checked))
    picked = [name(old).alias(new) for new, old in columns.items()]
    kept = rows.select(*picked, F.monotonically_increasing_id().alias("row"), vector.alias("v"))
    return store_once(kept.filter(F.col("v").isNotNull()), "vectors")


def matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width`` int64; shorter ones end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out
