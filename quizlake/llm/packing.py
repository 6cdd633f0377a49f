"""Vector best-fit packing of tokenized documents, planned once per length."""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizlake.llm.arrays import give_back
from quizlake.llm.columns import text_of
from quizlake.llm.pieces import kept_in_worker, spaced_words
from quizlake.session import store_once

_SHIFT = 44
# Bytes of text encoded together.
CHUNK = 6_000_000


def _piece_batches(batches, path: str, end_id: int, capacity: int, chunk: int):
    table = kept_in_worker(("spaced", path), partial(spaced_words, path))
    for batch in batches:
        doc_ids, rows, at = batch.column(0).to_pylist(), [], 0
        for ids, ends in table.ids(batch.column(1), chunk):
            first = 0
            for end in ends.tolist():
                data = ids[first:end].tobytes() + end_id.to_bytes(4, "little")
                total, start, piece = end - first + 1, 0, 0
                while start < total:
                    length = (total % capacity or capacity) if start == 0 else capacity
                    crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                    rows.append((doc_ids[at], piece, start, length, crc))
                    start, piece = start + length, piece + 1
                first, at = end, at + 1
        columns = zip(*rows) if rows else [[]] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )
    give_back()


def token_pieces(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    capacity: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """Documents as token pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32.

    The ids are those of the ``tokenizers`` library for the whole text, then ``end_id``. Only
    longer documents are cut; the first piece takes what the full ones leave over. About ``chunk``
    bytes of text are encoded together: fewer take less memory and more time, with the same result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(partial(_piece_batches, path=path, end_id=end_id, capacity=capacity, chunk=chunk), schema)


def plan_packing(
    counts: dict[int, int],
    tokens: int,
    documents: int,
    attention: int,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> list[tuple[int, list[int]]]:
    """Bins as (how many, lengths in them), by vector best-fit decreasing over whole lengths.

    An item of ``n`` tokens takes (n, 1, n * n) of a bin's residual tokens, documents and
    attention cost. Among the bins that it fits under every constraint, ``norm`` takes the
    least weighted norm of what would be left, ``dot`` the greatest weighted dot product of
    item and residual. Items of one length are alike and so are bins of one filling, so the
    plan moves them in groups; its size depends on the number of lengths, not of documents.
    """
    caps = np.array([tokens, documents, attention], float)
    scale = np.array(weights, float)
    too_large = [n for n in counts if n > tokens or n * n > attention]
    if too_large or documents < 1:
        raise ValueError(f"pieces of {too_large or 'any'} tokens fit no sequence")
    residual = np.empty((0, 3))
    numbers = np.empty(0, np.int64)
    content: list[tuple[int, ...]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        item = np.array([length, 1, length * length], float)
        while left:
            fits = np.flatnonzero((numbers > 0) & (residual >= item).all(axis=1))
            if len(fits):
                if rule == "norm":
                    best = fits[np.argmin((scale * ((residual[fits] - item) / caps) ** 2).sum(axis=1))]
                else:
                    best = fits[np.argmax((scale * residual[fits] * item / caps**2).sum(axis=1))]
                taken, room, inside = min(left, int(numbers[best])), residual[best] - item, (*content[best], length)
                numbers[best] -= taken
            else:
                # A bin opened for the largest item left takes as many of it as the others allow.
                room, inside, taken = caps - item, (length,), left
                same = int(min(tokens // length, documents, attention // (length * length)))
                if same > 1:
                    taken = -(-left // same)
            left -= taken
            residual = np.vstack([residual, room])
            numbers = np.append(numbers, taken)
            content.append(inside)
            if len(content) > 4096:
                alive = np.flatnonzero(numbers > 0)
                # Bins of one filling are one group.
                merged: dict[tuple[int, ...], int] = {}
                for k in alive:
                    merged[content[k]] = merged.get(content[k], 0) + int(numbers[k])
                content = list(merged)
                numbers = np.array([merged[c] for c in content], np.int64)
                residual = caps - np.array([[sum(c), len(c), sum(n * n for n in c)] for c in content], float)
    return [(int(n), list(c)) for n, c in zip(numbers, content) if n > 0]


def _slots(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """The plan by length: which ranks of a length go to which sequences, and where."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append(((length << _SHIFT) + rank, rank, first, offset))
            used[length] = rank + times
            offset += length
        first += times
    rows.sort()
    return {name: np.array([r[k] for r in rows], np.int64) for k, name in enumerate(("key", "rank", "first", "offset"))}


def _place(frames, slots: dict[str, np.ndarray]):
    # The tokenizer and its words are not needed any more.
    kept_in_worker(("places",), dict)
    for frame in frames:
        key = (frame["length"].to_numpy() << _SHIFT) + frame["rank"].to_numpy()
        at = np.searchsorted(slots["key"], key, "right") - 1
        frame["sequence_id"] = slots["first"][at] + frame["rank"].to_numpy() - slots["rank"][at]
        frame["offset"] = slots["offset"][at]
        yield pd.DataFrame(frame.drop(columns="rank"))
    give_back()


def pack_pieces(
    pieces: DataFrame,
    tokens: int = 2048,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and the gapless ``offset`` inside the sequence.

    Bins hold at most ``tokens`` tokens, ``documents`` pieces and ``attention`` cost (the sum
    of squared lengths); the defaults of the last two never bind. Pieces are counted by
    length (at most ``tokens`` rows reach the driver), bins are planned on the counts, and
    every piece finds its place from its number among those of its length. Numbers come
    from hash shards of each length, so a length that a third of all pieces share is
    numbered by all tasks. Repeated rows are packed each by itself; no rows give none.
    """
    spark = pieces.sparkSession
    stored = store_once(pieces, "pieces")
    counts = {row["length"]: row["count"] for row in stored.groupBy("length").count().collect()}
    if not counts:
        return stored.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    plan = plan_packing(counts, tokens, documents or tokens, attention or tokens * tokens, weights, rule)
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    sizes = dealt.groupBy("length", "shard").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.partitionBy("length").orderBy("shard")) - F.col("rows")
    offsets = sizes.select("length", "shard", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (
        dealt.withColumn("inside", inside)
        .join(offsets, ["length", "shard"])
        .withColumn("rank", (F.col("inside") + F.col("before")).cast("long"))
        .select(*pieces.columns, "rank")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    # Positions in the plan's sorted slots; the plan is bounded, so it travels with the task.
    return ranked.mapInPandas(partial(_place, slots=_slots(plan)), f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, chunk: int = CHUNK, **options
) -> DataFrame:
    """``token_pieces`` of ``docs`` packed by ``pack_pieces``. Null texts are the end id alone."""
    return pack_pieces(token_pieces(docs, path, end_id, capacity, chunk=chunk), capacity, **options)
