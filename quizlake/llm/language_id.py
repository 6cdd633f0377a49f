"""Language by error-correcting output codes over byte n-gram classifiers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quizlake.llm.arrays import chunks, give_back
from quizlake.llm.columns import others_of
from quizlake.llm.pieces import kept_in_worker

UNKNOWN = "und"
ORDERS = (2, 3)
BUCKETS = 1 << 14
TRAIN_DOCS = 3_000
# Bytes of text counted together; what is made of them takes about 60 times as much memory.
_CHUNK = 250_000


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn(doc_id: Column, share: Column) -> Column:
    """Whether the hash of an id falls into ``share`` of its range."""
    return (share >= 1) | (F.xxhash64(doc_id).cast("double") / 2.0**64 + 0.5 < share)


def _folded() -> np.ndarray:
    """Bytes with A-Z lower-cased and every other ASCII byte that is no letter as a blank."""
    fold = np.arange(256, dtype=np.uint32)
    fold[ord("A") : ord("Z") + 1] += 32
    for low, high in ((0, ord("A")), (ord("Z") + 1, ord("a")), (ord("z") + 1, 128)):
        fold[low:high] = 32
    return fold


_FOLD = _folded()


def gram_places(data: np.ndarray, bounds: np.ndarray):
    """For each order: hashed places of all n-grams of the chunk, and which lie inside one text."""
    folded = _FOLD[data]
    for number, order in enumerate(ORDERS):
        size = len(folded) - order + 1
        if size <= 0:
            continue
        mixed = np.zeros(size, np.uint32)
        for k in range(order):
            mixed = mixed * np.uint32(0x01000193) ^ folded[k : k + size]
        places = ((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64) + number * BUCKETS
        whole = np.ones(size, bool)
        for end in range(1, order):
            across = bounds[1:-1] - end
            whole[across[(across >= 0) & (across < size)]] = False
        yield places, whole


def _count_batches(batches, langs: list[str]):
    """Per task: counts of every hashed n-gram by language."""
    kept_in_worker(("language",), dict)
    wide = BUCKETS * len(ORDERS)
    totals = np.zeros(len(langs) * wide, np.int64)
    number = {lang: k for k, lang in enumerate(langs)}
    for batch in batches:
        own = np.array([number[lang] for lang in batch.column(0).to_pylist()], np.int64)
        for first, data, bounds in chunks(batch.column(1), _CHUNK):
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for places, whole in gram_places(data, bounds):
                kept = np.flatnonzero(whole)
                lang = own[first + text[kept]]
                totals += np.bincount(lang * wide + places[kept], minlength=len(totals))
    found = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays(
        [pa.array((found // wide).astype(np.int32)), pa.array((found % wide).astype(np.int32)), pa.array(totals[found])],
        ["lang", "place", "n"],
    )
    give_back()


def _least_distance(code: np.ndarray, block: int = 1_000) -> int:
    """In how many bits the two closest rows differ."""
    whole, least = code.astype(np.float32), code.shape[1]
    for start in range(0, len(code), block):
        apart = (code.shape[1] - whole[start : start + block] @ whole.T) / 2
        apart[np.arange(len(apart)), start + np.arange(len(apart))] = code.shape[1]
        least = min(least, int(apart.min()))
    return least


def codewords(n: int, seed: int = 7, tries: int = 200) -> np.ndarray:
    """A row of +1/-1 bits per language: every split up to five languages, else random ones.

    Of random codes the one whose closest two rows differ most is taken.
    """
    if n <= 1:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        splits = [[1 if k == 0 else (1 if mask >> (k - 1) & 1 else -1) for k in range(n)] for mask in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.int8).T
    random = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, distance = None, -1
    for _ in range(tries):
        code = random.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = _least_distance(code)
        if apart > distance:
            best, distance = code, apart
    return best


@dataclass
class Model:
    """``weights`` per hashed n-gram and bit, scaled so that a typical text of either side gives 1."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def train(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS
) -> Model:
    """Fit one binary n-gram classifier per code bit on about ``train_docs`` texts of each language.

    Learns only from text and non-null language of documents outside the held-out fold. The
    sample is drawn by a hash of the id, so it does not depend on partitions. A classifier
    is the log ratio of smoothed n-gram shares of the two sides, every language counting
    alike. The n-gram counts are summed by Spark; the table that reaches the driver has a row
    per language and hash bucket.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    ).filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    codes = codewords(len(langs))
    wide = BUCKETS * len(ORDERS)
    if not langs:
        return Model([], codes, np.zeros((wide, 0), np.float32), np.zeros(0))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(train_docs / n)).otherwise(share)
    sample = rows.filter(drawn(F.col("doc_id"), share) & F.col("text").isNotNull()).select("lang", "text")
    counted = sample.mapInArrow(partial(_count_batches, langs=langs), "lang int, place int, n long")
    table = counted.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), wide))
    counts[table["lang"].to_numpy(), table["place"].to_numpy()] = table["n"].to_numpy()
    shares = np.zeros_like(counts)
    for number in range(len(ORDERS)):
        part = slice(number * BUCKETS, (number + 1) * BUCKETS)
        own = counts[:, part] + 0.1
        shares[:, part] = own / own.sum(axis=1, keepdims=True)
    weights = np.zeros((wide, codes.shape[1]))
    trust = np.zeros(codes.shape[1])
    for bit in range(codes.shape[1]):
        one, other = codes[:, bit] > 0, codes[:, bit] < 0
        ratio = np.log(shares[one].mean(axis=0) / shares[other].mean(axis=0))
        typical = (shares * ratio).sum(axis=1) / len(ORDERS) * codes[:, bit]
        weights[:, bit] = ratio / max(typical.mean(), 1e-6)
        # A bit whose weakest language is still well apart decides more.
        trust[bit] = max(typical.min() / max(typical.mean(), 1e-6), 0.05)
    return Model(langs, codes, weights.astype(np.float32), trust)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best and second language number and the best one's score, by loss-weighted distance.

    A codeword's distance is the logistic loss of every bit's margin against it, weighted by
    the bit's trust.
    """
    if len(model.langs) == 1:
        zero = np.zeros(len(margins), np.int64)
        return zero, zero, np.ones(len(margins))
    agree = np.clip(margins, -4, 4)[:, None, :] * model.codes[None, :, :]
    distance = (np.log1p(np.exp(-2 * agree)) * model.trust).sum(axis=2) / model.trust.sum()
    order = np.argsort(distance, axis=1, kind="stable")
    share = np.exp(-8 * (distance - distance.min(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    return order[:, 0], order[:, 1], share[np.arange(len(order)), order[:, 0]]


def _predict_batches(batches, model: Model, carry: bool):
    kept_in_worker(("language",), dict)
    for batch in batches:
        texts = batch.column(1)
        rest = [k for k in range(batch.num_columns) if carry or k != 1]
        margins = np.zeros((len(texts), model.codes.shape[1]))
        grams = np.zeros(len(texts))
        for first, data, bounds in chunks(texts, _CHUNK):
            n = len(bounds) - 1
            filled = np.flatnonzero(np.diff(bounds))
            for places, whole in gram_places(data, bounds):
                worth = model.weights.take(places, axis=0)
                worth[~whole] = 0
                size = len(places)
                own = filled[bounds[filled] < size]
                if not len(own):
                    continue
                margins[first + own] += np.add.reduceat(worth, bounds[own], axis=0, dtype=np.float64)
                grams[first : first + n][own] += np.add.reduceat(whole.astype(np.int64), bounds[own])
        margins /= np.maximum(grams, 1)[:, None]
        best, second, score = decode(model, margins)
        names = np.array(model.langs, object)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(k) for k in rest],
                pa.array(names[best], pa.string()),
                pa.array(names[second], pa.string()),
                pa.array(score, pa.float64()),
            ],
            [*[batch.schema.names[k] for k in rest], "best", "second", "share"],
        )
    give_back()


def predict(
    docs: DataFrame,
    model: Model,
    doc_id: str = "doc_id",
    text: str = "text",
    ambiguous_below: float = 0.5,
    carry: bool = False,
) -> DataFrame:
    """Per row: doc_id, lang_pred, score, second language and whether the choice is ambiguous.

    Only the text decides. A text that is null or has no letter is ``und`` with score 0, as
    is every text if no language was learned. ``ambiguous`` marks a best language with less
    than ``ambiguous_below`` of the score. Repeated rows and ids are rows each; texts are read whole,
    however long. Empty tables give no rows. Other columns, whatever their names, are ignored;
    with ``carry`` every row also brings its text as ``text`` and the others in the struct ``others``.
    """
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.col(text) if carry else F.when(lettered, F.col(text))).alias("text"),
        lettered.alias("lettered"),
        *([others_of(docs, text)] if carry else []),
    )
    own = rows.columns if carry else ["doc_id", "lettered"]
    if model.langs:
        kinds = StructType([rows.schema[name] for name in own])
        kinds = kinds.add("best", "string").add("second", "string").add("share", "double")
        rows = rows.mapInArrow(partial(_predict_batches, model=model, carry=carry), kinds)
    else:
        nothing = {"lettered": F.lit(False), "share": F.lit(0.0)}
        rows = rows.withColumns(nothing | {name: F.lit(None).cast("string") for name in ("best", "second")})
    return rows.select(
        "doc_id",
        F.when(F.col("lettered"), F.col("best")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("share")).otherwise(0.0).alias("score"),
        F.when(F.col("lettered"), F.col("second")).alias("second"),
        (F.col("lettered") & (F.col("share") < ambiguous_below)).alias("ambiguous"),
        *(["text", "others"] if carry else []),
    )
