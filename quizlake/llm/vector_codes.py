"""Vector codes by parts: Lloyd's rounds over two trees, one of parts and one of codebook entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.vectors import matrix, whole_vectors
from quizlake.session import store_once

# Points in a leaf of the points' tree, children of an inner node, entries in a leaf of theirs.
_LEAF, _FAN, _ENTRY_LEAF = 16, 4, 8
_SUMS = "part int, entry int, axis int, total long, n long"


def _curve(points: np.ndarray) -> np.ndarray:
    """Places along a Z-order curve: neighbours there are near each other, any cut of it is a tree."""
    axes = min(points.shape[1], 60)
    bits = 60 // axes
    spread = points[:, :axes] - points[:, :axes].min(axis=0)
    wide = max(int(spread.max()).bit_length() - bits, 0)
    spread = spread >> wide
    place = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(axes):
            place = (place << 1) | ((spread[:, axis] >> bit) & 1)
    return place


@dataclass
class Boxes:
    """Nodes of one level: bounds, sums and counts of the points below, and the first child of each."""

    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    first: np.ndarray


def _levels(points: np.ndarray) -> list[Boxes]:
    """The tree over ``points`` in the order of the curve, leaves first, each level made from the one below."""
    first = np.arange(0, len(points), _LEAF)
    below = (points, points, points, np.ones(len(points), np.int64))
    levels = []
    while True:
        low, high = np.minimum.reduceat(below[0], first), np.maximum.reduceat(below[1], first)
        sums, counts = np.add.reduceat(below[2], first), np.add.reduceat(below[3], first)
        levels.append(Boxes(low, high, sums, counts, np.append(first, len(below[0]))))
        if len(first) == 1:
            return levels
        below, first = (low, high, sums, counts), np.arange(0, len(first), _FAN)


def _bounds(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between the boxes of each pair."""
    gap = np.maximum(np.maximum(low - high2, low2 - high), 0)
    reach = np.maximum(high - low2, high2 - low)
    return (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... sizes[i] numbers for each i, one behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


class Codebook:
    """Distinct entries of one part in a tree of two levels; of equal entries the first stands for all."""

    def __init__(self, entries: np.ndarray):
        _, number = np.unique(entries, axis=0, return_index=True)
        self.number = number[np.argsort(_curve(entries[number]), kind="stable")]
        self.points = entries[self.number]
        first = np.arange(0, len(self.points), _ENTRY_LEAF)
        self.low, self.high = np.minimum.reduceat(self.points, first), np.maximum.reduceat(self.points, first)
        self.first = np.append(first, len(self.points))


def _prune(pairs_node: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which pairs stay: those whose least distance is within the least largest one of their node."""
    start = np.flatnonzero(np.append(True, pairs_node[1:] != pairs_node[:-1]))
    limit = np.minimum.reduceat(far, start)
    return near <= np.repeat(limit, np.diff(np.append(start, len(pairs_node))))


def assign(points: np.ndarray, book: Codebook, n_entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of every point (ties to the lower number), sums and counts by entry.

    Pairs of a node of points and a node of entries, then single entries, go from the top of the points' tree
    down. A pair is dropped when its boxes are farther apart than another entry can be from any point of the
    node. A node with one entry left is assigned whole, by its cached sum and count. What the leaves
    leave open is settled by exact distances, whose number is the last value returned.
    """
    order = np.argsort(_curve(points), kind="stable")
    points = points[order]
    levels = _levels(points)
    chosen = np.zeros(len(points), np.int64)
    totals = np.zeros((n_entries, points.shape[1]), np.int64)
    counts = np.zeros(n_entries, np.int64)

    # The top: nodes of entries first, then the entries of those that stay.
    top = levels[-1]
    near, far = _bounds(top.low.repeat(len(book.low), 0), top.high.repeat(len(book.low), 0), book.low, book.high)
    groups = np.flatnonzero(near <= far.min())
    entry = _spans(book.first[groups], book.first[groups + 1] - book.first[groups])
    node = np.zeros(len(entry), np.int64)
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        if below is not None:
            # Children take the entries of their parent, tested by nodes of entries before one by one.
            node, entry = below
            group = np.searchsorted(book.first, entry, "right") - 1
            head = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (group[1:] != group[:-1])))
            near, far = _bounds(level.low[node[head]], level.high[node[head]], book.low[group[head]], book.high[group[head]])
            stay = np.repeat(_prune(node[head], near, far), np.diff(np.append(head, len(node))))
            node, entry = node[stay], entry[stay]
        near, far = _bounds(level.low[node], level.high[node], book.points[entry], book.points[entry])
        stay = _prune(node, near, far)
        node, entry = node[stay], entry[stay]
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        left = np.diff(np.append(head, len(node)))
        whole = head[left == 1]
        number = book.number[entry[whole]]
        np.add.at(totals, number, level.sums[node[whole]])
        np.add.at(counts, number, level.counts[node[whole]])
        # The points of a node stand side by side.
        start, stop = node[whole], node[whole] + 1
        for lower in range(depth, -1, -1):
            start, stop = levels[lower].first[start], levels[lower].first[stop]
        chosen[_spans(start, stop - start)] = np.repeat(number, stop - start)
        open_ = np.repeat(left > 1, left)
        node, entry = node[open_], entry[open_]
        if not len(node):
            return _unsorted(chosen, order), totals, counts, 0
        # Every child with every entry of its parent: one block of pairs per child.
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        left = np.diff(np.append(head, len(node)))
        children = level.first[node[head] + 1] - level.first[node[head]]
        child = _spans(level.first[node[head]], children)
        below = (np.repeat(child, np.repeat(left, children)), entry[_spans(np.repeat(head, children), np.repeat(left, children))])
    point, entry = below
    # Lower numbers first within a point, so that the first of the least distances is the lowest number.
    by_number = np.lexsort((book.number[entry], point))
    point, entry = point[by_number], entry[by_number]
    away = ((points[point] - book.points[entry]) ** 2).sum(axis=1)
    head = np.flatnonzero(np.append(True, point[1:] != point[:-1]))
    least = np.repeat(np.minimum.reduceat(away, head), np.diff(np.append(head, len(point))))
    hits = np.flatnonzero(away == least)
    hits = hits[np.append(True, point[hits][1:] != point[hits][:-1])]
    number = book.number[entry[hits]]
    chosen[point[hits]] = number
    np.add.at(totals, number, points[point[hits]])
    np.add.at(counts, number, 1)
    return _unsorted(chosen, order), totals, counts, len(away)


def _unsorted(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def _entry_sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per part, entry and axis of what this task's points sum up to."""
    parts, n_entries, axes = books.shape
    trees = [Codebook(book) for book in books]
    totals, counts = np.zeros(books.shape, np.int64), np.zeros((parts, n_entries), np.int64)
    for batch in batches:
        if batch.num_rows:
            cut = matrix(batch["v"], parts * axes).reshape(-1, parts, axes)
            for part in range(parts):
                _, sums, found, _ = assign(cut[:, part], trees[part], n_entries)
                totals[part] += sums
                counts[part] += found
    part, entry, axis = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, books.shape))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(part.astype(np.int32)),
            pa.array(entry.astype(np.int32)),
            pa.array(axis.astype(np.int32)),
            pa.array(totals[part, entry, axis]),
            pa.array(counts[part, entry]),
        ],
        ["part", "entry", "axis", "total", "n"],
    )


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, n_entries, axes = books.shape
    trees = [Codebook(book) for book in books]
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = matrix(batch["v"], parts * axes).reshape(-1, parts, axes)
        chosen = np.stack([assign(cut[:, part], trees[part], n_entries)[0] for part in range(parts)], axis=1)
        error = ((cut - books[np.arange(parts), chosen]) ** 2).sum(axis=(1, 2))
        text = [row.tobytes().hex() for row in chosen.astype(np.uint8)]
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], batch["label"], pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"]
        )


def encode(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Every vector as one entry number per part, with what that loses.

    A component x counts as floor(scale * x). Each part position has a codebook that starts as that part
    of the rows with the smallest vec_ids; ``rounds`` times every part goes to its nearest entry (ties to the
    lower number) and every entry to the floor of the mean of its parts, an unused one stays. Returns vec_id,
    code (two hex digits a part), error (squared distances summed over parts), label_error (errors
    summed over rows with the same label) and codebooks_sha256.

    Each task builds a tree over the parts in an Arrow batch, in Z-order, with the bounds, sum and count of
    every node, and walks it together with a tree over the entries, see ``assign``; all numbers are whole,
    so pruning never changes a result. A round sends one row per part, entry, axis and task; the
    codebooks, entries * components numbers whatever the data, are the only thing that the driver
    reads and sends out.

    Vectors that are null, empty or hold null or non-finite components are left out. Equal vec_ids start the
    codebooks in the order of their vectors, a null one behind all others; repeated rows are coded
    each. Null labels are one label. Fewer rows than ``entries`` start smaller codebooks. An empty
    table gives no rows; other columns, whatever their names, are ignored. Vectors of unlike
    lengths, or of a length that ``parts`` does not divide, are an error, as is a component beyond
    2^26 after scaling.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry number has two hex digits: 1 to 256 entries")
    kept = whole_vectors(vectors, scale, {"vec_id": vec_id, "label": label}, embedding).filter(F.size("v") > 0).drop("row")
    shortest, longest = kept.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if shortest != longest or (longest or 0) % parts:
        raise ValueError(f"vectors of {shortest} to {longest} components cannot be cut into {parts} equal parts")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    axes = (longest or parts) // parts
    books = np.array([row.v for row in first], np.int64).reshape(-1, parts, axes).transpose(1, 0, 2)
    if not first:
        books = np.zeros((parts, 1, axes), np.int64)
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(partial(_entry_sums, books=books), _SUMS)
        sums = sums.groupBy("part", "entry", "axis").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for row in sums.collect():  # at most one row per number of the codebooks
            books[row.part, row.entry, row.axis] = row.total // row.n
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    label_type = kept.schema["label"].dataType.simpleString()
    kind = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {label_type}, code string, error long"
    coded = store_once(kept.mapInArrow(partial(_codes, books=books), kind), "vector-codes")
    # Summed up before the shuffle; a hot label is cut by AQE, as nothing but the result follows.
    by_label = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("same"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
