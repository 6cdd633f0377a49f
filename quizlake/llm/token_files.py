"""Documents as files of range-coded token blocks, in id order, and back."""

from __future__ import annotations

import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizlake.llm.columns import text_of
from quizlake.llm.pieces import bare_words, kept_in_worker
from quizlake.llm.range_coder import decode_blocks, encode_blocks
from quizlake.session import scratch_path

BLOCK = 4096
LANES = 1536
SMALLEST = -9_223_372_036_854_775_808
_FILE = "part int, block int, first long, n_ids int, data binary"
# Of each document in a block: id, whether the id is null, place of its first id in the part,
# ids before the block, ids in it, ids in all.
_FIELDS = 6


def _times(a: int, b: int) -> int:
    """Product in the CRC's field."""
    # Fixed value: the reflected CRC-32 polynomial.
    poly = 0xEDB88320
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (poly if b & 1 else 0)
    return product


@lru_cache(64)
def _power(k: int) -> int:
    """x to the power of 8 times 2^k."""
    return _times(_power(k - 1), _power(k - 1)) if k else 1 << 23


@lru_cache(4096)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 times ``n_bytes``."""
    product = 1 << 31
    for k in range(n_bytes.bit_length()):
        if n_bytes >> k & 1:
            product = _times(_power(k), product)
    return product


def _crc_moved(crc: int, n_bytes: int) -> int:
    """What ``crc`` adds to the checksum when ``n_bytes`` follow: times x^(8n) in the CRC's field."""
    return _times(_shift(n_bytes), crc)


def _pack_parts(batches, path: str, end_id: int, vocabulary: int, block: int, lanes: int):
    table = kept_in_worker(("bare", path), partial(bare_words, path))
    part = TaskContext.get().partitionId()
    own_end = np.array([end_id], np.int32)
    state = {"held": [], "n_held": 0, "docs": [], "at": 0, "block": 0}

    def flush(final: bool):
        """Code ``lanes`` whole blocks, at the end all; a document cut at a block's end stands in both."""
        ids = np.concatenate(state["held"]) if state["held"] else np.zeros(0, np.int32)
        n_blocks = -(-len(ids) // block) if final else lanes
        first = state["at"]
        stop = min(len(ids), n_blocks * block)
        pieces = [ids[k * block : min((k + 1) * block, stop)] for k in range(n_blocks)]
        docs = np.array(state["docs"], np.int64).reshape(-1, 4)
        begins, ends = docs[:, 2], docs[:, 2] + docs[:, 3]
        lows = first + np.arange(n_blocks) * block
        highs = np.minimum(lows + block, first + stop)
        # A row for each document of each block.
        low_doc = np.searchsorted(ends, lows, "right")
        sizes = np.searchsorted(begins, highs) - low_doc
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        own = docs[np.arange(bounds[-1]) + np.repeat(low_doc - bounds[:-1], sizes)]
        low, high = np.repeat(lows, sizes), np.repeat(highs, sizes)
        before = np.maximum(low - own[:, 2], 0)
        inside = np.minimum(own[:, 2] + own[:, 3], high) - np.maximum(own[:, 2], low)
        indices = np.column_stack([own[:, 0], own[:, 1], own[:, 2], before, inside, own[:, 3]]).astype("<i8")
        rows = []
        for k, data in enumerate(encode_blocks(pieces, vocabulary) if pieces else []):
            index = indices[bounds[k] : bounds[k + 1]].tobytes()
            head = np.array([len(index), zlib.crc32(index)], "<u4").tobytes()
            rows.append((part, state["block"] + k, int(lows[k]), len(pieces[k]), head + index + data))
        state.update(held=[ids[stop:]], n_held=len(ids) - stop, at=first + stop, block=state["block"] + n_blocks)
        state["docs"] = [d for d in state["docs"] if d[2] + d[3] > state["at"]]
        columns = zip(*rows) if rows else [[]] * 5
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], ["part", "block", "first", "n_ids", "data"]
        )

    ended = 0
    for batch in batches:
        doc_ids, at = batch.column(0), 0
        for ids, ends in table.ids(batch.column(1)):
            begin = 0
            for end in ends.tolist():
                doc_id = doc_ids[at].as_py()
                state["docs"].append((SMALLEST if doc_id is None else doc_id, doc_id is None, ended, end - begin + 1))
                state["held"] += [ids[begin:end], own_end]
                state["n_held"] += end - begin + 1
                ended += end - begin + 1
                begin, at = end, at + 1
                # Enough is left for the last blocks not to be few: a step costs much the same for few.
                while state["n_held"] >= block * lanes * 3 // 2:
                    yield flush(False)
    yield flush(True)


def write_token_files(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    vocabulary: int = 49_408,
    doc_id: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
    lanes: int = LANES,
) -> None:
    """Write the ids of ``docs`` to ``folder``: documents by ascending id, each with ``end_id``.

    One row of the files is one block of at most ``block`` ids: an index of the documents in
    it and the coded ids, each with its checksum. Blocks reset the coder, so they decode
    alone. Ids are ordered by ranges, one shuffle of the texts; the range's number is the
    part's number. Null texts count as empty, null ids come first; equal ids are ordered by
    text. A task writes a whole part, so a lost task is simply run again.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    ordered = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "text"
    )
    coder = partial(
        _pack_parts, path=path, end_id=end_id, vocabulary=vocabulary, block=block, lanes=lanes
    )
    ordered.mapInArrow(coder, _FILE).write.parquet(folder)


def _unpack(batches, vocabulary: int, lanes: int):
    for batch in batches:
        # Even slices of about that many blocks: a step costs much the same for few.
        n_slices = max(1, (batch.num_rows + lanes // 2) // lanes)
        size_of_slice = max(1, -(-batch.num_rows // n_slices))
        for begin in range(0, batch.num_rows, size_of_slice):
            part = batch.slice(begin, size_of_slice)
            rows, coded = [], []
            data = part.column(1).to_pylist()
            for record in data:
                size, crc = np.frombuffer(record[:8], "<u4").tolist()
                if zlib.crc32(record[8 : 8 + size]) != crc:
                    raise ValueError("damaged document index")
                coded.append(record[8 + size :])
            for number, record, ids in zip(part.column(0).to_pylist(), data, decode_blocks(coded, vocabulary)):
                size = int(np.frombuffer(record[:4], "<u4")[0])
                index = np.frombuffer(record[8 : 8 + size], "<i8").reshape(-1, _FIELDS)
                raw, at = ids.astype("<u4").tobytes(), 0
                for doc_id, no_id, start, before, inside, total in index.tolist():
                    crc = zlib.crc32(raw[4 * at : 4 * (at + inside)])
                    after = total - before - inside
                    rows.append(
                        (None if no_id else doc_id, number, start, inside, _crc_moved(crc, 4 * after) if after else crc)
                    )
                    at += inside
        # One batch of rows per slice keeps the worker's memory to one slice of blocks.
            columns = zip(*rows) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], ["doc_id", "part", "place", "n", "crc"]
            )


def read_token_files(spark: SparkSession, folder: str, vocabulary: int = 49_408, lanes: int = LANES) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Raises if a checksum does not hold. Parts are counted from the files' own columns; the
    sums over parts have a row per part.
    """
    files = spark.read.schema(_FILE).parquet(folder)
    pieces = files.select("part", "data").mapInArrow(
        partial(_unpack, vocabulary=vocabulary, lanes=lanes), "doc_id long, part int, place long, n long, crc long"
    )
    # Checksums of a document's pieces, each moved to its place, add up by exclusive or.
    docs = pieces.groupBy("part", "place", "doc_id").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = sizes.select(
        "part", (F.sum("n_ids").over(W.orderBy("part")) - F.col("n_ids")).cast("long").alias("before")
    )
    return docs.join(before, "part").select(
        "doc_id", (F.col("place") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, path: str, end_id: int = 1, vocabulary: int = 49_408) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read the documents back from them."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, folder, path, end_id, vocabulary)
    return read_token_files(spark, folder, vocabulary)
