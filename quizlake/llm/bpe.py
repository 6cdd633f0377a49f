"""Byte-level BPE by monoid tree reduction: halves are encoded alone and joined at their boundary."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.columns import text_of
from quizlake.llm.pieces import Recent, WordTable, kept_in_worker

LEAF = 8


class TreeBpe:
    """Ranked byte merges. ``ranks`` maps the bytes of a token to its id and rank.

    Why joining is exact: a sequence of tokens is the encoding of its bytes if and only if
    each two neighbours are the encoding of theirs, since merges only ever look at neighbours.
    All neighbours inside an encoded half are such pairs, and so are those inside the window
    encoded anew at the boundary; the two pairs at the window's edges are tested. If one
    fails, the window grows.
    """

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.bytes_of = {number: token for token, number in ranks.items()}
        self.short = Recent(lambda new: [self._merged(data) for data in new])
        self.pairs = Recent(lambda new: [self._stable(pair) for pair in new])

    def merged(self, data: bytes) -> list[int]:
        return self.short(data) if len(data) <= 2 * self.leaf else self._merged(data)

    def _merged(self, data: bytes) -> list[int]:
        """All merges in rank order over ``data``, with a heap of neighbour pairs."""
        ranks, size = self.ranks, len(data)
        if size == 1 or data in ranks:
            return [ranks[data]] if size else []
        parts: list[bytes | None] = [data[i : i + 1] for i in range(size)]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(rank, i) for i in range(size - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            own, j = parts[i], after[i]
            if own is None or j >= size or ranks.get(own + parts[j]) != rank:
                continue
            parts[i], parts[j], k = own + parts[j], None, after[j]
            after[i] = k
            if k < size:
                before[k] = i
                if (new := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (new, i))
            if (h := before[i]) >= 0 and (new := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (new, h))
        return [ranks[part] for part in parts if part is not None]

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` side by side stay as they are."""
        return self.pairs((a, b))

    def _stable(self, pair: tuple[int, int]) -> bool:
        return self.merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == [*pair]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two halves' bytes from their encodings."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            head, tail = left[:-width] if width < len(left) else [], right[width:]
            window = self.merged(self.decode(left[len(head) :] + right[:width]))
            if (not head or self.stable(head[-1], window[0])) and (not tail or self.stable(window[-1], tail[0])):
                return head + window + tail
            width *= 2

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token: halves down to ``leaf`` bytes, joined on the way up."""
        if len(data) <= self.leaf or data in self.ranks:
            return self.merged(data)
        middle = len(data) // 2
        return self.join(self.encode(data[:middle]), self.encode(data[middle:]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, halves concatenated up the tree."""
        if len(ids) <= 64:
            return b"".join([self.bytes_of[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def text_encoder(path: str, pattern: str) -> WordTable:
    """Encodings as (number of ids, ids as decimal text, decoded bytes)."""
    bpe, splits = TreeBpe(read_ranks(path)), regex.compile(pattern)

    def encode(text: str) -> tuple[int, str, bytes]:
        ids: list[int] = []
        for piece in splits.findall(text):
            ids += bpe.encode(piece.encode())
        return len(ids), " ".join(map(str, ids)), bpe.decode(ids)

    def join(a, b):
        return a[0] + b[0], f"{a[1]} {b[1]}", a[2] + b[2]

    return WordTable(lambda texts: [*map(encode, texts)], join=join)


def _encode_batches(batches, path: str, pattern: str):
    table = kept_in_worker(("tree-bpe", path, pattern), partial(text_encoder, path, pattern))
    for batch in batches:
        counts, ids, data = [], [], []
        for offsets, numbers, encodings in table.cut(batch.column(1)):
            sizes, id_texts, decoded = zip(*encodings)
            if offsets is None:
                counts += sizes
                ids.append(_sha(id_texts[0].encode()))
                data.append(_sha(decoded[0]))
                continue
            ends = np.concatenate([[0], np.cumsum(np.array(sizes)[np.asarray(numbers)])])
            counts += np.diff(ends[np.asarray(offsets) - offsets[0].as_py()]).tolist()
            texts = _joined(offsets, pa.array(id_texts, pa.large_string()).take(numbers), " ")
            ids += [_sha(text.as_buffer() if n else b"") for text, n in zip(texts, sizes and counts[-len(texts) :])]
            data += [_sha(part.as_buffer()) for part in _joined(offsets, pa.array(decoded, pa.large_binary()).take(numbers), b"")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _sha(raw) -> str:
    return hashlib.sha256(raw).hexdigest()


def _joined(offsets: pa.Array, words: pa.Array, between):
    return pc.binary_join(pa.LargeListArray.from_arrays(pc.cast(offsets, pa.int64()), words), pa.scalar(between, words.type))


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, and SHA-256 of the ids and of the bytes decoded from them.

    Every match of ``pattern`` is encoded by itself. Null texts count as empty and have no
    ids. Rows pass through one by one, repeated ones too; an empty table gives no rows.
    ``path`` must be readable on the executors.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(partial(_encode_batches, path=path, pattern=pattern), schema)
