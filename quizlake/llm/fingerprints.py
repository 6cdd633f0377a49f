"""Bottom-k sketches of word shingles, mergeable, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizlake.llm.columns import BLANK_RUN, text_of

SHINGLE = 5
SKETCH = 128


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_RUN, -1), lambda word: word != "")


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """A hash per run of ``size`` words; a shorter text is one shingle, no words are none.

    ``words`` must be a column, not an expression: it is read once per shingle.
    """
    run = lambda start: F.xxhash64(*[F.get(words, start + k) for k in range(size)])
    return (
        F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), run))
        .when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def bottom_k(hashes: Column, k: int = SKETCH) -> Column:
    """The ``k`` smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of the union of two shingle sets, from their sketches."""
    return bottom_k(F.concat(a, b), k)


def merged_sketches(df: DataFrame, by: list[str], sketch: str, k: int = SKETCH) -> DataFrame:
    """One sketch per group of parts: the ``k`` smallest distinct hashes over all its rows.

    Ranks are cut before the shuffle, so a group of any number of parts sends ``k`` rows a task.
    """
    parts = df.select(*by, F.explode(sketch).alias("__hash")).distinct()
    rank = F.row_number().over(W.partitionBy(*by).orderBy("__hash"))
    least = parts.withColumn("__rank", rank).filter(F.col("__rank") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("__hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard similarity, exact while the union has at most ``k`` shingles."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    mine = F.array_intersect(a, union)
    both = F.size(F.array_intersect(mine, b))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both, F.size(mine)), F.lit(0.0)))


def distinct_shingles(sketch: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    place = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(float(k - 1)) / place)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_sketches(df: DataFrame, texts: dict[str, str], size: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """Add a sketch column for each text column named."""
    steps = df.withColumns({f"__words_{name}": words_of(text_of(source)) for name, source in texts.items()})
    steps = steps.withColumns({f"__hashes_{name}": shingle_hashes(F.col(f"__words_{name}"), size) for name in texts})
    steps = steps.withColumns({name: bottom_k(F.col(f"__hashes_{name}"), k) for name in texts})
    return steps.drop(*[f"__{kind}_{name}" for kind in ("words", "hashes") for name in texts])


def fingerprint_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, k: int = SKETCH
) -> DataFrame:
    """Sketches of every document and its edited text, and how alike neighbours are.

    The next document is the one with the next smaller id; after the smallest comes the
    largest. The edited text ends in the next document's beginning for its last half.
    Returns doc_id, n_chars, edited_text, sketch, edited_sketch, near_edited, near_next.

    Documents are dealt into id ranges of about equal size, one shuffle of the texts in all;
    each range also gets a copy of the first document of the range after it. A range's window
    sees text in id order.

    Null texts count as empty, a null id as the smallest. Rows of one id follow each other by
    text. A single document is its own next one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    smallest = -9_223_372_036_854_775_808
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(smallest)).alias("id"),
        F.col(doc_id).cast("long").alias("doc_id"),
        text_of(text).alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("id", shares).alias("c")).first()["c"] if shares else None
    cuts = sorted(set(cuts or []))
    bucket = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda cut: cut < F.col("id"))) if cuts else F.lit(0)
    dealt = rows.withColumn("bucket", bucket)
    # At most one row per range reaches the driver.
    firsts = {r["bucket"]: r["id"] for r in dealt.groupBy("bucket").agg(F.max("id").alias("id")).collect()}
    order = sorted(firsts, reverse=True)
    before = {firsts[own]: order[k - 1] for k, own in enumerate(order)}
    if not before:
        before = {0: 0}
    place = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    copies = (
        dealt.filter(F.col("id").isin(list(before)))
        .groupBy("id", "doc_id")
        .agg(F.min("text").alias("text"))
        .select("id", "doc_id", "text", F.element_at(place, F.col("id")).cast("int").alias("bucket"), F.lit(1).alias("copy"))
    )
    in_order = W.partitionBy("bucket").orderBy("copy", F.desc("id"), "text")
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n_chars - half),
        F.when(half > 0, F.substring(F.coalesce(F.col("next"), F.lit("")), F.lit(1), half)).otherwise(F.lit("")),
    )
    joined = (
        dealt.withColumn("copy", F.lit(0))
        .unionByName(copies)
        .withColumn("next", F.lead("text").over(in_order))
        .withColumn("n_chars", n_chars.cast("long"))
        .withColumn("edited_text", edited)
    )
    sketched = with_sketches(joined, {"sketch": "text", "edited_sketch": "edited_text"}, size, k)
    return (
        sketched.withColumn("next_sketch", F.lead("sketch").over(in_order))
        .filter(F.col("copy") == 0)
        .select(
            "doc_id",
            "n_chars",
            "edited_text",
            "sketch",
            "edited_sketch",
            resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
            resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        )
    )
