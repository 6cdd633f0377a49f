"""Exact top-k by inner product in three phases with one threshold for all lists of a query."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.llm.vectors import matrix, whole_vectors
from quizlake.session import store_once

_LISTS = "query long, part int, least long, rows array<long>, scores array<long>"
_ENTRIES = "block long, shard long, query long, part int, rows array<long>, scores array<long>"
_FOUND = "query long, query_id long, row long, vec_id long, score long"
# Queries whose scores against a shard are in memory at once.
_TILE = 64


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products; by the fast floating product where it cannot round."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    bound = int(np.abs(queries).max()) * int(np.abs(vectors).max()) * queries.shape[1]
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


def _tiles(asked: pa.Table, held: pa.Table, width: int):
    """Per tile of queries: their numbers in ``asked``, all scores, and where a query meets itself."""
    queries, vectors = matrix(asked["v"], width), matrix(held["v"], width)
    own, rows = asked["row"].to_numpy(), held["row"].to_numpy()
    for start in range(0, len(queries), _TILE):
        numbers = np.arange(start, min(start + _TILE, len(queries)))
        yield numbers, rows, _products(queries[numbers], vectors), rows[None, :] == own[numbers, None]


def _local_lists(held: pa.Table, asked: pa.Table, k: int, width: int) -> pa.Table:
    """Phase 1 in a shard: per query and part the ``k`` best partial scores and the least one."""
    out = []
    part = asked["part"][0].as_py() if len(asked) else 0
    for numbers, rows, scores, own in _tiles(asked, held, width) if len(held) else ():
        for i, number in enumerate(numbers):
            others = np.flatnonzero(~own[i])
            if len(others):
                mine = scores[i, others]
                best = np.argpartition(-mine, k - 1)[:k] if len(mine) > k else np.arange(len(mine))
                out.append((asked["row"][int(number)].as_py(), part, int(mine.min()), rows[others[best]], mine[best]))
    return _table(out, ["query", "part", "least", "rows", "scores"])


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    kinds = {"part": pa.int32(), "rows": pa.list_(pa.int64()), "scores": pa.list_(pa.int64())}
    return pa.table({name: pa.array(list(column), kinds.get(name, pa.int64())) for name, column in zip(names, columns)})


def _sufficient_entries(held: pa.Table, asked: pa.Table, parts: int, width: int) -> pa.Table:
    """Phase 2 in a shard: per query and part every entry that reaches its share of the cutoff."""
    out = []
    if len(held) and len(asked):
        part, block, shard = (asked[name][0].as_py() for name in ("part", "block", "shard"))
        least, cutoff = asked["least"].to_numpy(), asked["cutoff"].to_numpy()
        for numbers, rows, scores, own in _tiles(asked, held, width):
            reach = (parts * (scores - least[numbers, None]) >= cutoff[numbers, None]) & ~own
            for i, number in enumerate(numbers):
                hits = np.flatnonzero(reach[i])
                if len(hits):
                    out.append((block, shard, asked["row"][int(number)].as_py(), part, rows[hits], scores[i, hits]))
    return _table(out, ["block", "shard", "query", "part", "rows", "scores"])


def _resolve(entries: pa.Table, whole: pa.Table, k: int, parts: int, width: int) -> pa.Table:
    """Phase 3 in a shard: what an entry lacks is computed, and each query's ``k`` best stay."""
    found = {name: [] for name in ("query", "query_id", "row", "vec_id", "score")}
    asking = whole["asked"].to_numpy(zero_copy_only=False)
    vectors = matrix(whole["v"], parts * width)
    rows, ids = whole["row"].to_numpy(), whole["vec_id"]
    numbers = np.flatnonzero(~asking)
    numbers = numbers[np.argsort(rows[numbers])]
    held = rows[numbers]
    query_at = {int(rows[i]): int(i) for i in np.flatnonzero(asking)}
    by_query: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    offsets = {name: entries[name].combine_chunks() for name in ("rows", "scores")}
    for i, (query, part) in enumerate(zip(entries["query"].to_pylist(), entries["part"].to_pylist())):
        lists = [offsets[name][i].values.to_numpy() for name in ("rows", "scores")]
        by_query.setdefault(query, []).append((part, *lists))
    for query, lists in by_query.items():
        seen = np.unique(np.concatenate([entry_rows for _, entry_rows, _ in lists]))
        score, known = np.zeros(len(seen), np.int64), np.zeros((parts, len(seen)), bool)
        for part, entry_rows, scores in lists:
            at = np.searchsorted(seen, entry_rows)
            score[at] += scores
            known[part, at] = True
        places = numbers[np.searchsorted(held, seen)]
        at_query = query_at[query]
        for part in range(parts):
            lacking = np.flatnonzero(~known[part])
            columns = slice(part * width, (part + 1) * width)
            score[lacking] += _products(vectors[at_query : at_query + 1, columns], vectors[places[lacking], columns])[0]
        if len(seen) > k:  # all that tie with the k-th stay; ids settle them
            kth = np.partition(score, len(score) - k)[len(score) - k]
            best = np.flatnonzero(score >= kth)
        else:
            best = np.arange(len(seen))
        vec_ids = [ids[int(places[i])].as_py() for i in best]
        order = sorted(range(len(best)), key=lambda i: (-score[best[i]], vec_ids[i] is None, vec_ids[i] or 0, seen[best[i]]))[:k]
        found["query"] += [query] * len(order)
        found["query_id"] += [ids[at_query].as_py()] * len(order)
        found["row"] += [int(seen[best[i]]) for i in order]
        found["vec_id"] += [vec_ids[i] for i in order]
        found["score"] += [int(score[best[i]]) for i in order]
    return pa.table({name: pa.array(values, pa.int64()) for name, values in found.items()})


def _each(n: int) -> Column:
    """A row for each number from 0 to ``n`` - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _dealt(vectors: DataFrame, own: str, other: str, n_other: int, parts: int, width: int, *keep: str) -> DataFrame:
    """Vectors cut into parts and sent to each of the ``n_other`` groups they meet."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, width))
    sent = vectors.select("row", own, *keep, _each(n_other).alias(other), "v")
    # Named anew, as both sides of a meeting come from one table.
    named = [F.col(name).alias(name) for name in ("row", own, other, *keep)]
    return sent.select(*named, F.posexplode(pieces).alias("part", "v"))


def search(
    vectors: DataFrame,
    asked: Column,
    k: int = 10,
    scale: int = 1024,
    parts: int = 2,
    shard_rows: int = 8192,
    block_queries: int = 512,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The ``k`` rows with the highest inner product for every row whose vec_id satisfies ``asked``.

    ``asked`` is a condition on the column vec_id. Each component x counts as floor(scale * x); a row is no
    answer to itself. Returns query_id, rank from 1, vec_id, score; ties go to the smaller vec_id, fewer
    rows than ``k`` give all.

    A score is a sum over ``parts`` of the vector, and each part has a list of partial scores per
    query, spread over shards. Phase 1 takes the ``k`` best of every list and the list's least score,
    and resolves those few rows: the k-th best of their exact scores is a safe cutoff, as k rows
    reach it. Counted from the least scores up, a row whose partial scores all stay below cutoff / parts
    stays below the cutoff. Phase 2 sends the query's cutoff to all its lists and collects every entry that
    reaches the share, ties included. Phase 3 computes what the collected rows lack and ranks them.
    All numbers are whole, so nothing is rounded. On the given vectors two parts collect
    a tenth of all entries and four already half of them, so two is the default.

    Queries in blocks meet rows in shards, one task a pair; both are cut by a number of the row, so
    no id, however frequent, fills one. A task holds a block, a shard and the entries of their
    pairs (at most block_queries * shard_rows a part); a query's lists, cutoffs and answers are
    settled by grouping, never on the driver or by broadcast.

    Vectors that are null or hold null or non-finite components take no part, as query or as
    answer; an empty vector scores 0, shorter ones count as if they ended in zeros. A null vec_id is never
    a query and ranks last among ties. Rows with one vec_id are rows of their own: each asks, and
    each is an answer to the others. An empty table or query set gives no rows; other columns,
    whatever their names, are ignored. A component beyond 2^26 after scaling is an error.
    """
    stored = whole_vectors(vectors, scale, {"vec_id": vec_id}, embedding)
    known = stored.withColumn("asked", F.coalesce(asked, F.lit(False)))
    n, n_asked, longest = known.agg(F.count("*"), F.count_if("asked"), F.max(F.size("v"))).first()
    width = max(1, -(-(longest or 0) // parts))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-(n_asked or 0) // block_queries))
    known = known.withColumns(
        {
            "shard": F.pmod(F.xxhash64("row"), F.lit(shards)),
            "block": F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)),
        }
    )
    queries = known.filter("asked")
    meet = ["block", "shard", "part"]
    held = _dealt(known, "shard", "block", blocks, parts, width)

    # Phase 1
    asking = _dealt(queries, "block", "shard", shards, parts, width)
    lists = store_once(
        held.groupBy(*meet)
        .cogroup(asking.groupBy(*meet))
        .applyInArrow(partial(_local_lists, k=k, width=width), _LISTS),
        "search-lists",
    )
    entry = F.explode(F.arrays_zip("rows", "scores")).alias("entry")
    best_first = Window.partitionBy("query", "part").orderBy(F.desc("entry.scores"), "entry.rows")
    seen = (
        lists.select("query", "part", entry)
        .withColumn("place", F.row_number().over(best_first))
        .filter(F.col("place") <= k)
        .select("query", F.col("entry.rows").alias("row"))
        .distinct()
    )
    product = F.aggregate(
        F.zip_with("v", "asked_v", lambda x, y: F.coalesce(x.cast("long") * y, F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    scored = (
        seen.join(known.select("row", "v"), "row")
        .join(queries.select(F.col("row").alias("query"), F.col("v").alias("asked_v")), "query")
        .select("query", product.alias("score"))
    )
    kth = (
        scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
        .filter(F.col("place") == k)
        .select("query", "score")
    )
    leasts = (
        lists.groupBy("query", "part")
        .agg(F.min("least").alias("least"))
        .groupBy("query")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "least"))), lambda p: p["least"]).alias("leasts"),
            F.sum("least").alias("total"),
        )
    )
    # Fewer than k rows altogether: every entry is collected.
    cutoffs = leasts.join(kth, "query", "left").select(
        F.col("query").alias("row"), "leasts", F.coalesce(F.col("score") - F.col("total"), F.lit(0)).alias("cutoff")
    )

    # Phase 2
    cut = queries.join(store_once(cutoffs, "search-cutoffs"), "row")
    asking = _dealt(cut, "block", "shard", shards, parts, width, "leasts", "cutoff")
    asking = asking.withColumn("least", F.get("leasts", F.col("part"))).drop("leasts")
    entries = (
        held.groupBy(*meet)
        .cogroup(asking.groupBy(*meet))
        .applyInArrow(partial(_sufficient_entries, parts=parts, width=width), _ENTRIES)
    )

    # Phase 3
    here = known.select(_each(blocks).alias("block"), "shard", "row", "vec_id", "v", F.lit(False).alias("asked"))
    whole = here.unionByName(
        queries.select("block", _each(shards).alias("shard"), "row", "vec_id", "v", F.lit(True).alias("asked"))
    )
    found = (
        entries.groupBy("block", "shard")
        .cogroup(whole.groupBy("block", "shard"))
        .applyInArrow(partial(_resolve, k=k, parts=parts, width=width), _FOUND)
    )
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
