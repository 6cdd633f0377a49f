"""Near-duplicate documents: MinHash banding, then exact Jaccard on whole word n-gram sets."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.arrays import Spans, chunks, give_back, mixed, word_bounds
from quizlake.llm.columns import carried, named, others_of, text_of
from quizlake.llm.pieces import kept_in_worker
from quizlake.session import cut_lineage, store_once

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.999
GROUP = 600_000
TILE = 512
# The ASCII blanks that part words.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def bands_for(similarity: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes with ``recall``.

    A pair at ``similarity`` s meets in a band of r rows with chance s^r; more rows keep more
    unlike pairs apart, and b bands miss with chance (1 - s^r)^b.
    """
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes do not reach recall {recall} at {similarity}")
    return best


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _ngram_sets(texts: pa.Array, size: int):
    """(number of the first text, sorted distinct n-gram hashes, their bounds) by chunk.

    A text of fewer than ``size`` words is one n-gram of all its words; no words, none.
    """
    steps = _multipliers(size + 1)
    for first, data, bounds in chunks(texts):
        starts, ends, own = word_bounds(~_BLANK[data], bounds)
        words = Spans(data).hashes(starts, ends)
        n = len(bounds) - 1
        numbers = np.searchsorted(own, np.arange(n + 1))
        lengths = np.diff(numbers)
        total = len(words)
        grams = np.zeros(total, np.uint64)
        for k in range(size):
            grams[: total - k] += words[k:] * steps[k]
        # An n-gram must end in its own text; a short text keeps its first place, over what it has.
        place = np.arange(total) - numbers[own]
        kept = place <= lengths[own] - size
        for text in np.flatnonzero((lengths > 0) & (lengths < size)):
            head = numbers[text]
            grams[head] = (words[head : numbers[text + 1]] * steps[: lengths[text]]).sum() + steps[size]
            kept[head] = True
        grams, owner = mixed(grams[kept]), own[kept]
        cuts = np.searchsorted(owner, np.arange(n + 1))
        sets = [np.unique(grams[cuts[k] : cuts[k + 1]]) for k in range(n)]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        yield first, np.concatenate([*sets, np.zeros(0, np.uint64)]), ends


def _signature_batches(batches, size: int, bands: int, rows: int):
    factors = _multipliers(bands * rows + 2)
    kept_in_worker(("signatures",), dict)
    for batch in batches:
        out = []
        for first, grams, ends in _ngram_sets(batch.column(1), size):
            n = len(ends) - 1
            filled = np.flatnonzero(np.diff(ends))
            at = ends[filled]
            keys = np.zeros((n, bands), np.uint64)
            marks = np.zeros((n, 2), np.uint64)
            if len(filled):
                for k in range(2):
                    marks[filled, k] = np.add.reduceat(mixed(grams * factors[bands * rows + k]), at)
                for band in range(bands):
                    key = np.zeros(len(filled), np.uint64)
                    for row in range(rows):
                        least = np.minimum.reduceat(grams * factors[band * rows + row], at)
                        key = mixed(key * factors[0] + least + np.uint64(row))
                    keys[filled, band] = mixed(key + np.uint64(band))
            flat = pa.array(keys.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat)
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(2).slice(first, n),
                        pa.array(marks[:, 0].view(np.int64)),
                        pa.array(marks[:, 1].view(np.int64)),
                        pa.array(np.diff(ends)),
                        lists,
                    ],
                    ["doc_id", "text_mark", "mark_1", "mark_2", "n_grams", "bands"],
                )
            )
        yield from out
    give_back()


_SIGNATURE = "doc_id long, text_mark long, mark_1 long, mark_2 long, n_grams long, bands array<long>"


def components(edges: DataFrame) -> DataFrame:
    """(node, least): the least node that each node of undirected ``edges`` (a, b) is linked to.

    Every round a node takes the least label among its neighbours' and then its label's
    label, so labels run along doubled paths. Rounds are cut by checkpoints.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("least").alias("near"))
        found = labels.join(near, F.col("a") == F.col("node")).select(
            "node", "least", F.least("least", "near").alias("step")
        )
        jump = labels.select(F.col("node").alias("step"), F.col("least").alias("far"))
        found = found.join(jump, "step", "left").select(
            "node", "least", F.coalesce(F.least("step", "far"), F.col("step")).alias("new")
        )
        found = cut_lineage(found)
        labels, moved = found.select("node", F.col("new").alias("least")), found.filter("new < least").limit(1)
        if not moved.count():
            return labels


def _pairs_in(left, right, same: bool, similarity: float):
    """Linked pairs between two lists of (sets, bands), as two index arrays."""
    sets_a, bands_a = left
    sets_b, bands_b = right
    sizes_a, sizes_b = (np.array([len(s) for s in sets]) for sets in (sets_a, sets_b))
    for i in range(0, len(sets_a), TILE):
        for j in range(i if same else 0, len(sets_b), TILE):
            own_a, own_b = bands_a[i : i + TILE], bands_b[j : j + TILE]
            meet = np.zeros((len(own_a), len(own_b)), bool)
            for band in range(own_a.shape[1]):
                meet |= own_a[:, band][:, None] == own_b[:, band][None, :]
            if same and i == j:
                meet = np.triu(meet, 1)
            if not meet.any():
                continue
            rows, columns = np.flatnonzero(meet.any(axis=1)), np.flatnonzero(meet.any(axis=0))
            picked = [*(sets_a[i + k] for k in rows), *(sets_b[j + k] for k in columns)]
            owner = np.repeat(np.arange(len(picked)), [len(s) for s in picked])
            values, inverse, counts = np.unique(np.concatenate(picked), return_inverse=True, return_counts=True)
            shared = counts > 1
            width = int(shared.sum())
            place = np.cumsum(shared) - 1
            common = np.zeros((len(rows), len(columns)), np.float32)
            owner, column = owner[shared[inverse]], place[inverse[shared[inverse]]]
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            for low in range(0, width, 4096):
                part = slice(np.searchsorted(column, low), np.searchsorted(column, low + 4096))
                dense = np.zeros((len(picked), min(4096, width - low)), np.float32)
                dense[owner[part], column[part] - low] = 1
                common += dense[: len(rows)] @ dense[len(rows) :].T
            total = sizes_a[i + rows][:, None] + sizes_b[j + columns][None, :] - common
            linked = meet[np.ix_(rows, columns)] & (common >= similarity * total - 1e-6)
            a, b = np.nonzero(linked)
            yield i + rows[a], j + columns[b]


def _link_group(frame: pd.DataFrame, size: int, similarity: float) -> pd.DataFrame:
    """Links inside one chunk or between two chunks of a group: counts, and a spanning edge each."""
    frame = frame.sort_values(["side", "node"], ignore_index=True)
    sets: list[np.ndarray] = []
    for _, grams, ends in _ngram_sets(pa.array(frame["text"], pa.large_string()), size):
        sets += [grams[a:b] for a, b in zip(ends[:-1], ends[1:])]
    bands = np.array(frame["bands"].tolist(), np.int64).reshape(len(frame), -1)
    cut = int((frame["side"] == 0).sum())
    same = cut == len(frame)
    left = (sets[:cut], bands[:cut])
    right = left if same else (sets[cut:], bands[cut:])
    weight = frame["class_size"].to_numpy()
    links, distinct = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
    parent = np.arange(len(frame))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in _pairs_in(left, right, same, similarity):
        b = b if same else b + cut
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        np.add.at(distinct, a, 1)
        np.add.at(distinct, b, 1)
        # One union per row of the tile and other root is enough to connect them.
        for x, y in {(int(x), int(parent[y])) for x, y in zip(a, b)}:
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    ids = frame["node"].to_numpy()
    del sets, left, right, bands
    give_back()
    least = np.array([root(k) for k in range(len(frame))], np.int64)
    return pd.DataFrame({"node": ids, "other": ids[least], "links": links, "near_classes": distinct})


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = NGRAM,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    group: int = GROUP,
) -> DataFrame:
    """Per row: doc_id, class_id, class_size, group_id, n_links, near_classes, n_grams, class_head,
    text_mark, group_node.

    Documents with equal sets of ``size``-word n-grams (words between ASCII blanks) are one
    class, named after its smallest id. Classes link when the Jaccard similarity of their
    sets is at least ``similarity``; a pair is looked at if it shares a MinHash band, which
    a pair at the threshold does with chance ``recall`` or more. ``n_links`` counts the other
    documents linked (those of the class too), ``near_classes`` the other classes, and
    ``group_id`` is the smallest id connected over any number of links. ``class_head`` marks
    one row of each class, ``text_mark`` is a hash of the text. Ids may repeat or be null, so
    unlike groups can have one ``group_id``; ``group_node`` is a number of the group's own.

    Bands are shuffled by their hash as narrow rows. Classes that share bands form candidate
    groups; only these fetch their texts. A group of more than ``group`` n-grams is dealt into
    chunks, and every two chunks meet in a task of their own, so a group of near copies of
    any size is split, all its pairs are compared, and none is ever a row.

    Null and empty texts and texts of blanks have no n-grams and are one class without links
    to others. A null id counts as the largest id. Rows of one id are rows of their own. An
    empty table gives no rows.
    """
    bands, rows = bands_for(similarity, recall)
    largest = 9_223_372_036_854_775_807
    raw = text_of(text)
    own = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(largest)).alias("doc_id"),
        raw.alias("text"),
        F.xxhash64(raw).alias("text_mark"),
    )
    signer = partial(_signature_batches, size=size, bands=bands, rows=rows)
    signed = own.mapInArrow(signer, _SIGNATURE).withColumn("row", F.monotonically_increasing_id())
    signed = store_once(signed, "signatures")
    key = ["mark_1", "mark_2", "n_grams"]
    classes = signed.groupBy(*key).agg(
        F.min("doc_id").alias("class_id"), F.min("row").alias("node"), F.count("*").alias("class_size")
    )
    classes = store_once(classes, "classes")
    heads = signed.join(classes.filter("n_grams > 0").select("node", "class_size"), F.col("row") == F.col("node"))
    heads = heads.select("node", "class_size", "doc_id", "text_mark", "n_grams", "bands")
    banded = heads.select("node", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    edges = banded.join(leaders, "band").filter("node <> leader").select(
        F.col("node").alias("a"), F.col("leader").alias("b")
    )
    candidates = components(edges).select("node", F.col("least").alias("candidate"))
    in_groups = store_once(heads.join(candidates, "node"), "candidates")
    sizes = in_groups.groupBy("candidate").agg(F.sum("n_grams").alias("grams"))
    sizes = sizes.select("candidate", F.ceil(F.col("grams") / group).cast("int").alias("chunks"))
    dealt = in_groups.join(sizes, "candidate").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    )
    # Rows repeated with one id and text are one text.
    texts = dealt.join(own, ["doc_id", "text_mark"]).dropDuplicates(["node"])
    met = texts.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "candidate",
        F.least("chunk", "with").alias("low"),
        F.greatest("chunk", "with").alias("high"),
        (F.col("chunk") > F.col("with")).cast("int").alias("side"),
        "node",
        "class_size",
        "bands",
        "text",
    )
    linked = met.groupBy("candidate", "low", "high").applyInPandas(
        partial(_link_group, size=size, similarity=similarity), "node long, other long, links long, near_classes long"
    )
    linked = store_once(linked, "links")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("near_classes").alias("near_classes"))
    joined = components(linked.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    grouped = classes.join(counts, "node", "left").join(joined, "node", "left")
    grouped = grouped.withColumn("group", F.coalesce("least", "node"))
    named = grouped.groupBy("group").agg(F.min("class_id").alias("group_id"))
    shown = lambda column: F.when(F.col(column) < largest, F.col(column)).alias(column)
    return (
        signed.select("doc_id", "text_mark", "row", *key)
        .join(grouped.join(named, "group"), key)
        .select(
            shown("doc_id"),
            shown("class_id"),
            "class_size",
            shown("group_id"),
            (F.coalesce("links", F.lit(0)) + F.col("class_size") - 1).alias("n_links"),
            F.coalesce("near_classes", F.lit(0).cast("long")).alias("near_classes"),
            "n_grams",
            (F.col("row") == F.col("node")).alias("class_head"),
            "text_mark",
            F.col("group").alias("group_node"),
        )
    )


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id.

    Documents without near duplicates stay, also those that share an id or have none; of rows
    repeated as they are, one stays. Of texts of one group and id, that of the smallest hash stays.
    Texts are compared whole, however long; null and empty ones are one class. An empty table gives
    no rows. All columns come back as they were, whatever their names.
    """
    largest = 9_223_372_036_854_775_807
    found = near_duplicates(docs, doc_id, text, **options)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("group_id"))).groupBy("group_node", "group_id")
    first = first.agg(F.min("text_mark").alias("__own")).select(
        F.coalesce("group_id", F.lit(largest)).alias("__doc"), "__own"
    )
    marked = docs.select(
        F.xxhash64(text_of(text)).alias("__own"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(largest)).alias("__doc"),
        named(text).alias("text"),
        others_of(docs, text),
    )
    kept = marked.join(first, ["__doc", "__own"]).dropDuplicates(["__doc", "__own"])
    return kept.select(*carried(docs, text))
