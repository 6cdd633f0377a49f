"""Toxicity of texts whose disguised words are first restored over a noisy channel.

A word that may be disguised (leetspeak, spaced-out letters, marks put in, letters repeated) opens
a lattice: every character offers the letters it may stand for, at the channel's cost, or nothing.
Viterbi takes the path that is cheapest under the channel and a character language model of the
corpus. A logistic model over hashed words and word beginnings scores the restored text alone.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quizlake.llm.arrays import Spans, chunks, give_back, mixed, word_bounds
from quizlake.llm.columns import others_of
from quizlake.llm.language_id import drawn, held_out
from quizlake.llm.pieces import Recent, kept_in_worker
from quizlake.session import store_once

TRAIN_ROWS = 20_000
FEATURES = 4_096
_BITS = 20
_PREFIXES = (4, 5, 6)
# Bytes of text whose words are hashed together.
_CHUNK = 250_000
# Letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
# Channel costs in nats: a stand-in character, a dropped repetition, a dropped mark, a mark that
# parts words; a character that can stand in for a letter seldom is a mere mark.
_STAND_IN, _REPEAT, _DROP, _PART, _MERE = 0.5, 0.5, 0.5, 1.5, 8.0
# Plain words have figures or marks behind them, and a double letter, seldom several:
# the cost of a letter of a pair is shared by the pairs of the word.
_EDGE, _END, _PAIR = 4.0, 1.5, 9.0
# Symbols of the character model: blank 0, a to z 1 to 26, any other letter its code point. Blanks and
# a to z are counted exactly, n-grams with other letters in this many slots by their length.
_PLAIN = 27
_SLOTS = {1: 1 << 16, 2: 1 << 18, 3: 1 << 20}
_SMOOTH = 20

_L, _S, _M = "A-Za-z", "".join(f"\\{c}" if not c.isalnum() else c for c in LEET), r".*_~^\-"
# What may part spaced-out letters: ASCII blanks and marks that are no stand-ins, and wide blanks and dots.
_GAP = "".join(f"\\x{k:02x}" for k in range(128) if not chr(k).isalnum() and chr(k) not in LEET)
_GAP += "\x85\xa0\xb7\u2000-\u206f\u3000\ufeff"
# Spaced-out letters; a stand-in beside a letter; a letter repeated; marks inside a word.
_SPACED = rf"(?:[{_L}{_S}][{_GAP}]+){{2,}}[{_L}{_S}]"
_BESIDE = rf"[{_L}][{_S}]|[{_S}][{_L}]|[{_L}][{_M}]+[{_L}]"
_TWICE = "|".join(chr(k) * 2 for k in range(ord("a"), ord("z") + 1))
_SUSPECT = rf"(?:^|[^{_L}0-9]){_SPACED}(?:[^{_L}0-9]|$)|{_BESIDE}|(?i:{_TWICE})"
# The same for Python, without what stands around spaced-out letters.
_STRETCH = re.compile(rf"(?<![{_L}0-9]){_SPACED}(?![{_L}0-9])|{_BESIDE}|(?i:([a-z])\1)")
_RUN = re.compile(r"([a-z])\1+")
_LETTERS = re.compile(r"[^\W\d_]+")


def _symbol(char: str) -> int:
    """The symbol of a character: a letter's lower form; -1 for a combining mark, which is passed over."""
    low = char.lower()[0]
    if "a" <= low <= "z":
        return ord(low) - 96
    return ord(low) if low >= "\x80" and low.isalpha() else -1 if unicodedata.category(char)[0] == "M" else 0


def _symbols() -> np.ndarray:
    """Symbols of all code points."""
    table = np.zeros(0x110000, np.int32)
    table[:0x34000] = [_symbol(chr(code)) for code in range(0x34000)]
    return table


def _starts(order: int) -> tuple[int, int]:
    """Where the exact counts and the slots of n-grams of ``order`` begin."""
    start = sum(_PLAIN**k + _SLOTS[k] for k in range(1, order))
    return start, start + _PLAIN**order


def _places(grams: list[np.ndarray]) -> np.ndarray:
    """Where the n-grams, given as one array of symbols a position, are counted."""
    exact, slots = _starts(len(grams))
    own = np.zeros(len(grams[0]), np.int64)
    other = np.flatnonzero(np.maximum.reduce(grams) >= _PLAIN)
    code = np.zeros(len(other), np.uint64)
    for symbols in grams:
        own = own * _PLAIN + symbols
        code = code << np.uint64(21) | symbols[other].astype(np.uint64)
    own[other] = slots - exact + (mixed(code) % np.uint64(_SLOTS[len(grams)])).astype(np.int64)
    return exact + own


def _count_grams(batches):
    """Per task: counts of n-grams of symbols, runs of blanks as one, every text between blanks."""
    table = kept_in_worker(("symbols",), _symbols)
    totals = np.zeros(_starts(3)[1] + _SLOTS[3], np.int64)
    for batch in batches:
        for _, data, bounds in chunks(batch.column(0)):
            raw = np.insert(data, bounds, 32).tobytes().decode("utf-8", "replace")
            symbols = table[np.frombuffer(raw.encode("utf-32-le"), np.uint32)]
            symbols = symbols[symbols >= 0]
            symbols = symbols[np.insert((symbols[1:] != 0) | (symbols[:-1] != 0), 0, True)]
            for order in _SLOTS:
                if len(symbols) >= order:
                    places = _places([symbols[k : len(symbols) - order + 1 + k] for k in range(order)])
                    exact, slots = _starts(order)
                    totals[exact:slots] += np.bincount(places[places < slots] - exact, minlength=slots - exact)
                    np.add.at(totals, places[places >= slots], 1)
    found = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(totals[found])], ["place", "n"])
    give_back()


@dataclass
class Characters:
    """Counts of the n-grams of a corpus: ``places`` ascending, and the costs among blanks and a to z."""

    places: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        self.letters = max(int((self.places < _starts(2)[0]).sum()), 1)
        self.total = float(self.counts[self.places < _starts(2)[0]].sum())
        a, b, c = (axis.ravel() for axis in np.indices((_PLAIN,) * 3))
        self.plain = self.costs(a, b, c).reshape((_PLAIN,) * 3)

    def counted(self, *grams: np.ndarray) -> np.ndarray:
        places = _places(list(grams))
        at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        return np.where(self.places[at] == places, self.counts[at], 0.0) if len(self.places) else np.zeros(len(places))

    def costs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Negative log probabilities of symbols ``c`` after ``a`` and ``b``, smoothed by shorter contexts."""
        alone = (self.counted(c) + 1) / (self.total + self.letters + 1)
        after_one = (self.counted(b, c) + _SMOOTH * alone) / (self.counted(b) + _SMOOTH)
        after_two = (self.counted(a, b, c) + _SMOOTH * after_one) / (self.counted(a, b) + _SMOOTH)
        return np.maximum(-np.log(after_two), 0.0)


def character_model(docs: DataFrame, text: str = "text") -> Characters:
    """Counts of one, two and three symbols in a row over every text of ``docs``.

    The alphabet is that of the corpus: every letter of any script is a symbol of its own. Spark sums the
    counts; n-grams of blanks and a to z are counted exactly, the others in hashed slots, so that at most
    1.4 million counts reach the driver and the tasks whatever the corpus. Null texts are left out;
    without texts every symbol costs the same.
    """
    rows = docs.select(F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    counted = rows.mapInArrow(_count_grams, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counted = counted.sort_values("place")
    return Characters(counted["place"].to_numpy(np.int32), counted["n"].to_numpy(np.float64))


class Restorer:
    """Restores disguised words of texts under a character model."""

    def __init__(self, characters: Characters):
        self.characters = characters
        self.plain = characters.plain.tolist()
        self.others: dict[tuple[int, int, int], float] = {}
        self.suspect = _STRETCH
        self.memo = Recent(lambda words: [*map(self.changed, words)], 100_000)

    def changed(self, word: str) -> str:
        """The reading of a disguised word; empty if it has the words that stand there."""
        stands = _LETTERS.findall(word.lower())
        made = self.word(word) if stands else ""
        return "" if made.split() == stands else made

    def cost(self, a: int, b: int, c: int) -> float:
        """What symbol ``c`` costs after ``a`` and ``b``."""
        if a < _PLAIN and b < _PLAIN and c < _PLAIN:
            return self.plain[a][b][c]
        if (a, b, c) not in self.others:
            if len(self.others) >= 100_000:
                self.others.clear()
            self.others[a, b, c] = float(self.characters.costs(*(np.array([k]) for k in (a, b, c)))[0])
        return self.others[a, b, c]

    @staticmethod
    def lattice(word: str) -> list[list[tuple[int | None, str, float]]]:
        """For every character of a word what it may stand for: symbol (none if dropped), text, channel's cost."""
        before, word, offered = "", word.lower(), []
        last = max((k for k, char in enumerate(word) if char.isalpha()), default=len(word))
        runs = [len(found.group()) for found in _RUN.finditer(word)]
        pair = _PAIR / max(runs.count(2), 1)
        for k, char in enumerate(word):
            options: list[tuple[int | None, str, float]] = []
            if "a" <= char <= "z":
                options.append((ord(char) - 96, char, 0.0))
                if char == before:
                    double = word[k + 1 : k + 2] != char and word[max(k - 2, 0) : k - 1] != char
                    options.append((None, "", pair if double else _REPEAT))
            elif ord(char) >= 0x80 and char.isalpha():
                options.append((ord(char), char, 0.0))
            else:
                letters = LEET.get(char, "")
                mere = 0.0 if not letters else _MERE if k < last else _END if char == "!" else _EDGE
                options += [(ord(letter) - 96, letter, _STAND_IN) for letter in letters]
                options += [(0, " ", _PART + mere), (None, "", _DROP + mere)]
            before = char
            offered.append(options)
        return offered

    def word(self, word: str) -> str:
        """The cheapest reading of a disguised word: letters, and blanks where it is cut."""
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.lattice(word):
            reached: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in paths.items():
                for symbol, letter, price in options:
                    if symbol == 0 and b == 0:
                        continue
                    if symbol is None:
                        state, total, made = (a, b), cost + price, text
                    else:
                        state, total, made = (b, symbol), cost + price + self.cost(a, b, symbol), text + letter
                    if state not in reached or total < reached[state][0]:
                        reached[state] = (total, made)
            paths = reached
        ended = [(cost + (self.cost(a, b, 0) if b else 0.0), text) for (a, b), (cost, text) in paths.items()]
        return min(ended)[1]

    def text(self, text: str) -> str:
        """``text`` with every suspicious stretch, widened to blanks, replaced by its reading.

        A stretch without letters, or whose reading has the same words, stays as it is.
        """
        parts, done = [], 0
        for found in self.suspect.finditer(text):
            start, stop = found.span()
            if start < done:
                continue
            while start > done and not text[start - 1].isspace():
                start -= 1
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            made = self.memo(text[start:stop].strip())
            if made:
                parts += [text[done:start], " ", made, " "]
                done = stop
        return "".join([*parts, text[done:]]) if parts else text

    def all(self, texts: pa.Array) -> pa.Array:
        """The texts restored; those without anything suspicious are not looked at again."""
        marked = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _SUSPECT)))
        if not len(marked):
            return texts
        made = pa.array([self.text(text) for text in texts.take(marked).to_pylist()], texts.type)
        mask = np.zeros(len(texts), bool)
        mask[marked] = True
        return pc.replace_with_mask(texts, mask, made)


def restorer(characters: Characters) -> Restorer:
    mark = hash((characters.places.tobytes(), characters.counts.tobytes()))
    return kept_in_worker(("restorer", mark), lambda: Restorer(characters))


def _features(texts: pa.Array):
    """(number of the text, hashed feature) of every word and word beginning, in text order.

    A word with a letter repeated also counts as the word without the repetition: of one double letter
    the lattice cannot tell whether it belongs there.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    letter = np.zeros(256, bool)
    letter[ord("a") : ord("z") + 1] = letter[0x80:] = True
    for first, data, bounds in chunks(texts, _CHUNK):
        data = lower[data]
        starts, ends, own = word_bounds(letter[data], bounds)
        spans = Spans(data)
        made = [(own, spans.hashes(starts, ends) >> np.uint64(64 - _BITS))]
        again = np.append(False, (data[1:] == data[:-1]) & (data[1:] >= ord("a")) & (data[1:] <= ord("z")))[: len(data)]
        again[starts] = False
        place = np.append(0, np.cumsum(~again))
        single = np.flatnonzero(place[ends] - place[starts] < ends - starts)
        if len(single):
            once = Spans(data[~again]).hashes(place[starts[single]], place[ends[single]])
            made.append((own[single], once >> np.uint64(64 - _BITS)))
        for size in _PREFIXES:
            long = np.flatnonzero(ends - starts > size)
            salted = spans.hashes(starts[long], starts[long] + size) * np.uint64(2 * size + 1)
            made.append((own[long], salted >> np.uint64(64 - _BITS)))
        yield first + np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]).astype(np.int64)


def _sample_batches(batches, characters: Characters):
    read = restorer(characters)
    for batch in batches:
        texts = read.all(batch.column(1))
        pairs = [own * (1 << _BITS) + feature for own, feature in _features(texts)]
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        ends = np.searchsorted(pairs >> _BITS, np.arange(len(texts) + 1))
        features = pa.ListArray.from_arrays(
            pa.array(ends.astype(np.int32)), pa.array((pairs & ((1 << _BITS) - 1)).astype(np.int32))
        )
        yield pa.RecordBatch.from_arrays([batch.column(0), features], ["toxic", "features"])


@dataclass
class Model:
    characters: Characters
    features: np.ndarray
    weights: np.ndarray
    bias: float


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    train_rows: int = TRAIN_ROWS,
    features: int = FEATURES,
) -> Model:
    """Character model from all of ``docs``; logistic model from at most about ``train_rows`` labels.

    Labelled rows outside the held-out fold are drawn by a hash of the id. Candidate features
    are the ``features`` that tell the labels apart best by likelihood ratio, found by Spark
    over the sample, of those that at least five toxic rows of it hold and at least one in two hundred,
    and that toxic rows hold over three times as often. Both numbers bound what reaches the driver. Without labels of both kinds
    the model is the share of toxic labels, or one half.
    """
    characters = character_model(docs, text)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
        .groupBy("label_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    none = np.zeros(0, np.int64)
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 0.5) / (n + 1)
        return Model(characters, none, none.astype(float), float(np.log(share / (1 - share))))
    chosen_ids = known.filter(drawn(F.col("label_id"), F.lit(train_rows / n)))
    # At most about train_rows narrow rows: bounded by the parameter.
    rows = docs.select(F.col(doc_id).cast("long").alias("label_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = rows.join(F.broadcast(chosen_ids), "label_id").select("toxic", "text")
    sample = store_once(
        sample.mapInArrow(partial(_sample_batches, characters=characters), "toxic int, features array<int>"), "toxic-sample"
    ).withColumn("row", F.monotonically_increasing_id())
    sample = store_once(sample, "toxic-rows")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    if not ones or not zeros:
        share = (ones + 0.5) / (ones + zeros + 1)
        return Model(characters, none, none.astype(float), float(np.log(share / (1 - share))))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    gain = F.abs(a * F.log(a / (ones + 1)) - a * F.log((a + b) / (ones + zeros + 2)))
    best = (
        sample.select("toxic", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .filter((F.col("a") >= max(5, ones // 200)) & (F.col("a") * zeros > F.col("b") * ones * 3))
        .orderBy(F.desc(gain), "feature")
        .limit(features)
        .select("feature")
    )
    chosen = np.sort(best.toPandas()["feature"].to_numpy().astype(np.int64))
    wanted = F.lit(chosen.tolist()).cast("array<int>")
    table = sample.select("toxic", F.array_intersect("features", wanted).alias("features")).toPandas()
    lengths = table["features"].map(len).to_numpy()
    row = np.repeat(np.arange(len(table)), lengths)
    column = np.searchsorted(chosen, np.concatenate([*table["features"], none]).astype(np.int64))
    label = table["toxic"].to_numpy().astype(float)
    # Toxic rows again with most of their features hidden, so that one telling word is enough.
    random = np.random.default_rng(11)
    rows_made, columns_made, labels_made = [row], [column], [label]
    toxic = label[row] > 0
    for _ in range(2):
        seen = toxic & (random.random(len(row)) < 0.5)
        own, number = np.unique(row[seen], return_inverse=True)
        rows_made.append(number + sum(map(len, labels_made)))
        columns_made.append(column[seen])
        labels_made.append(np.ones(len(own)))
    row, column, label = map(np.concatenate, (rows_made, columns_made, labels_made))
    weights, bias = _logistic(row, column, label, len(chosen))
    return Model(characters, chosen, weights, bias)


def _logistic(row, column, label, width: int, steps: int = 1000, rate: float = 0.1, penalty: float = 1e-5):
    """Weights and bias of a ridge-penalised logistic model on presence features, by Adam."""
    theta = np.zeros(width + 1)
    theta[-1] = np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        margin = np.bincount(row, weights=theta[column], minlength=len(label)) + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) / len(label)
        slope = np.append(np.bincount(column, weights=error[row], minlength=width), error.sum())
        slope[:-1] += penalty * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    return theta[:-1], float(theta[-1])


def _score_batches(batches, model: Model, carry: bool):
    read = restorer(model.characters)
    weights = np.zeros(1 << _BITS)
    weights[model.features] = model.weights
    for batch in batches:
        given = batch.column(1).fill_null("")
        texts = read.all(given)
        margin = np.full(len(texts), model.bias)
        for own, feature in _features(texts):
            found = np.flatnonzero(weights.take(feature))
            if len(found):
                pairs = np.unique(own[found] * (1 << _BITS) + feature[found])
                np.add.at(margin, pairs >> _BITS, weights[pairs & ((1 << _BITS) - 1)])
        score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        changed = np.asarray(pc.not_equal(texts, given))
        rest = [k for k in range(batch.num_columns) if carry or k != 1]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in rest], pa.array(score), pa.array(changed)],
            [*[batch.schema.names[k] for k in rest], "score", "restored"],
        )
    give_back()


def score(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: bool = False
) -> DataFrame:
    """Per row: doc_id, score, predicted (1 from one half on), and whether a word was restored.

    Only the text decides. Null texts count as empty; empty texts get the model's bias. Rows
    pass one by one, repeated ones too; texts are read whole, however long. An empty table
    gives no rows. Other columns, whatever their names, are ignored; with ``carry`` every row also
    brings its text as ``text`` and the others in the struct ``others``.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        *([others_of(docs, text)] if carry else []),
    )
    own = rows.columns if carry else ["doc_id"]
    kinds = StructType([rows.schema[name] for name in own]).add("score", "double").add("restored", "boolean")
    scored = rows.mapInArrow(partial(_score_batches, model=model, carry=carry), kinds)
    return scored.select(
        "doc_id",
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "restored",
        *(["text", "others"] if carry else []),
    )
