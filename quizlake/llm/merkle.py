"""Merkle manifest of a table: roots of subtrees travel by butterfly exchange, proofs need no way down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.operators.keys import rank_rows
from quizlake.session import store_once

# Children of a node, as a power of two.
FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
# Levels of the tree that a block of consecutive leaves holds by itself.
BLOCK_LEVELS = 3

_LEVELS = "array<struct<before:string,after:string>>"


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def record_digest(values: list[Column]) -> Column:
    """Digest of a record: of each value its length in bytes, a colon and its text, of a null a dash."""
    texts = [value.cast("string") for value in values]
    fields = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return _sha(F.concat(*fields))


def _level_above(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda run: _sha(_joined(F.slice(nodes, run * FANOUT + 1, FANOUT))))


def _siblings(nodes: Column, place: Column) -> Column:
    """What stands before and behind ``place`` in its run of ``nodes``."""
    run = F.shiftright(place, FANOUT_BITS) * FANOUT
    digit = place.bitwiseAND(FANOUT - 1)
    return F.struct(
        _joined(F.slice(nodes, run + 1, digit)).alias("before"),
        _joined(F.slice(nodes, run + digit + 2, FANOUT - 1 - digit)).alias("after"),
    )


def butterfly(blocks: DataFrame, most_blocks: int) -> DataFrame:
    """Give every block of a tree its root and the siblings on the way there.

    ``blocks`` has tree (any type), block (from 0 without gaps within a tree), n_blocks of its tree,
    node (the digest it starts with) and levels (the siblings so far). In round r the blocks that differ in the
    r-th digit to the base of the fanout, and in no other, form a group and swap the roots of the subtrees
    of fanout^r blocks that they stand in; each hashes the same parent for itself and keeps the others
    as its siblings. After log(n_blocks) rounds each has the tree's root and its own proof, and nothing is
    sent down again. A round is one shuffle of a row per block; a group has at most ``FANOUT`` rows.

    Where the last subtree has fewer blocks than the others, its blocks also answer the groups that its
    missing blocks would be in, dealt evenly among them.
    """
    state = blocks
    for number in range(64):
        span = 1 << (FANOUT_BITS * number)  # blocks in a subtree now
        if span >= most_blocks:
            break
        live = F.col("n_blocks") > span
        lane = F.col("block").bitwiseAND(span - 1)
        run = F.shiftright("block", FANOUT_BITS * (number + 1))
        in_last = F.shiftright("block", FANOUT_BITS * number) == F.shiftright(F.col("n_blocks") - 1, FANOUT_BITS * number)
        there = F.when(in_last, F.col("n_blocks") - F.shiftright("block", FANOUT_BITS * number) * span).otherwise(span)
        # The last subtree alone in its run has nobody to answer but its own blocks.
        answers = in_last & (F.shiftright("block", FANOUT_BITS * number).bitwiseAND(FANOUT - 1) > 0)
        lanes = F.when(live & answers, F.sequence(lane, F.lit(span - 1).cast("bigint"), there)).otherwise(F.array(lane))
        sent = state.withColumn("lane", F.explode(lanes)).select(
            "tree",
            "n_blocks",
            F.when(live, run).otherwise(F.col("block")).alias("run"),
            F.when(live, F.col("lane")).otherwise(F.lit(-1)).alias("lane"),
            F.struct(
                F.shiftright("block", FANOUT_BITS * number).bitwiseAND(FANOUT - 1).cast("int").alias("digit"),
                "node",
                # A block that answers for a missing one gets nothing back.
                F.when(~live | (F.col("lane") == lane), F.col("block")).alias("block"),
                F.when(~live | (F.col("lane") == lane), F.col("levels")).alias("levels"),
            ).alias("peer"),
        )
        met = sent.groupBy("tree", "n_blocks", "run", "lane").agg(F.array_sort(F.collect_list("peer")).alias("peers"))
        met = met.withColumn("nodes", F.col("peers.node")).withColumn("parent", _sha(_joined(F.col("nodes"))))
        state = met.select("*", F.posexplode("peers").alias("place", "peer")).filter(F.col("peer.block").isNotNull()).select(
            "tree",
            F.col("peer.block").alias("block"),
            "n_blocks",
            F.when(live, F.col("parent")).otherwise(F.col("peer.node")).alias("node"),
            F.when(live, F.concat("peer.levels", F.array(_siblings(F.col("nodes"), F.col("place")))))
            .otherwise(F.col("peer.levels"))
            .alias("levels"),
        )
    return state


def manifest(
    rows: DataFrame,
    fields: list[str],
    tree: str,
    order: str,
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """Every row's leaf, its tree's root (subroot), the root over all trees, and its proof.

    A leaf is ``record_digest`` of ``fields``. Within a value of ``tree`` leaves ascend by ``order``; 8
    consecutive nodes at a time become the digest of their digests until one is left. The trees'
    roots, by the tree's value in byte order and null first, become ``root`` likewise.

    ``siblings`` lists what stands before and behind the row's node on each level up to ``root``. With
    ``altered`` (column name to its changed value) the changed record's leaf is folded up along the same
    siblings: ``folded_root`` equals ``root`` if nothing changed, and ``verified`` says so.

    Texts are hashed where they are read; only digests travel. Leaves get their places by ranges, a
    tree however large is cut into blocks of 8^3 leaves, and blocks meet eight at a time, so no task holds
    a tree. Rows with equal ``order`` stand by their leaf, a null ``order`` first; repeated rows are
    leaves of their own. Texts of any length and empty ones are hashed whole. An empty table gives no
    rows. Columns not named are ignored, whatever their names.
    """
    name = lambda column: F.col(f"`{column}`")
    changed = altered or {}
    leaves = rows.select(
        name(tree).cast("string").alias("tree"),
        name(order).alias("order"),
        record_digest([name(f) for f in fields]).alias("leaf"),
        record_digest([changed.get(f, name(f)) for f in fields]).alias("altered_leaf"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Hashed once, in the order of the scan: what deals the leaves out reads them twice.
    leaves = store_once(leaves, "merkle-leaves")
    placed = rank_rows(leaves, ["order", "leaf", "row"], "place", ["tree"]).withColumn("place", F.col("place") - 1)

    block_bits = FANOUT_BITS * BLOCK_LEVELS
    members = F.array_sort(F.collect_list(F.struct("place", "order", "leaf", "altered_leaf")))
    blocks = (
        placed.groupBy(F.struct("tree").alias("tree"), F.shiftright("place", block_bits).alias("block"))
        .agg(members.alias("members"))
        .withColumn("nodes_0", F.col("members.leaf"))
    )
    for level in range(BLOCK_LEVELS):
        blocks = blocks.withColumn(f"nodes_{level + 1}", _level_above(F.col(f"nodes_{level}")))
    blocks = store_once(blocks, "merkle-blocks")

    # A tree of one block ends at its first level of one node, any other fills the block's levels.
    sizes = blocks.groupBy("tree").agg(F.count("*").alias("n_blocks"))
    alone = F.col("n_blocks") == 1
    top = F.get(F.col(f"nodes_{BLOCK_LEVELS}"), F.lit(0))
    tops = [F.when(alone & (F.size(f"nodes_{level}") == 1), F.get(f"nodes_{level}", F.lit(0))) for level in range(BLOCK_LEVELS)]
    start = blocks.join(sizes, "tree").select(
        "tree", "block", "n_blocks", F.coalesce(*tops, top).alias("node"), F.array().cast(_LEVELS).alias("levels")
    )
    most = sizes.agg(F.max("n_blocks"), F.count("*")).first()
    inside = store_once(butterfly(start, most[0] or 0), "merkle-paths").withColumnRenamed("node", "subroot")

    subroots = inside.filter("block = 0").select(F.col("tree.tree").alias("value"), "subroot")
    ranked = rank_rows(subroots, ["value"], "place").select(
        (F.col("place") - 1).alias("block"), F.struct(F.col("value").alias("tree")).alias("tree"), "subroot"
    )
    tops = ranked.select(
        F.lit(0).alias("tree"),
        "block",
        F.lit(most[1]).cast("bigint").alias("n_blocks"),
        F.col("subroot").alias("node"),
        F.array().cast(_LEVELS).alias("levels"),
    )
    above = (
        butterfly(tops, most[1])
        .select("block", F.col("node").alias("root"), F.col("levels").alias("levels_above"))
        .join(ranked.select("block", "tree"), "block")
        .drop("block")
    )

    place = F.col("member.place").bitwiseAND((1 << block_bits) - 1).cast("int")
    in_block = [
        F.when(~alone | (F.size(f"nodes_{level}") > 1), F.array(_siblings(F.col(f"nodes_{level}"), F.shiftright(place, FANOUT_BITS * level))))
        .otherwise(F.array().cast(_LEVELS))
        for level in range(BLOCK_LEVELS)
    ]
    found = (
        blocks.join(inside.join(above, "tree"), ["tree", "block"])
        .withColumn("member", F.explode("members"))
        .select(
            F.col("member.order").alias(order),
            F.col("member.leaf").alias("leaf"),
            F.col("member.altered_leaf").alias("altered_leaf"),
            "subroot",
            "root",
            reduce(F.concat, [*in_block, F.col("levels"), F.col("levels_above")]).alias("siblings"),
        )
    )
    folded = F.aggregate("siblings", F.col("altered_leaf"), lambda node, level: _sha(F.concat(level["before"], node, level["after"])))
    proof = _sha(_joined(F.transform("siblings", lambda level: F.concat(level["before"], level["after"]))))
    return found.select(
        order, "leaf", "subroot", "root", "siblings", proof.alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
