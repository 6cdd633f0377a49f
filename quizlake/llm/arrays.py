"""Texts as numpy arrays: chunks of bytes, word bounds, and hashes of any span of a chunk."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1_000_000
# An odd base, its inverse modulo 2^64, and an odd multiplier for mixing.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, bounds of the texts in them) of about ``most`` bytes.

    A text longer than that is a chunk of its own. Nulls count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def give_back() -> None:
    """Return memory that this worker has freed to the system; the next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    hashes ^= hashes >> np.uint64(29)
    hashes *= _MIX
    return hashes ^ (hashes >> np.uint64(32))


class Spans:
    """Hashes of byte spans of ``data`` from one running sum."""

    def __init__(self, data: np.ndarray):
        size = len(data) + 1
        if len(_powers.get("up", ())) < size:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(max(size, CHUNK + 1), base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps, dtype=np.uint64)
        self.sums = np.zeros(size, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers["up"][: size - 1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * _powers["down"][starts])


def word_bounds(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of true in ``inside``, cut at text bounds."""
    size = len(inside)
    edge = np.zeros(size + 1, bool)
    edge[1:size] = inside[1:] != inside[:-1]
    edge[bounds] = True
    edge[size] = True
    cuts = np.flatnonzero(edge)
    if not len(cuts) or cuts[0] != 0:
        cuts = np.concatenate([[0], cuts])
    starts, ends = cuts[:-1], cuts[1:]
    words = inside[starts] if size else np.zeros(0, bool)
    starts, ends = starts[words], ends[words]
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1
