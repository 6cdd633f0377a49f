"""Texts cut where a tokenizer would cut anyway, so that a repeated word is encoded once.

Words are cut, numbered and put together again by Arrow and numpy over whole batches; only the
distinct words of a batch pass through Python, and only new ones through the tokenizer.
"""

from __future__ import annotations

import codecs
import operator
import os
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quizlake.llm.arrays import give_back

# Marks that a run at a word's end may consist of, none of which can start a
# contraction or combine with the letter before it.
_MARKS = ".,;:!?|$%*&#"
_BEFORE_MARKS = r"(?s)\A.*[^.,;:!?|$%*&#]"
# Blanks besides the space and the line feed, and characters some engines count as such.
_OTHER_BLANKS = r"[\x00-\x09\x0b-\x1f\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
# A text that has two blanks in a row, or one at either end, or an unusual one, is not cut.
_UNEVEN = _OTHER_BLANKS + r"|[ \n][ \n]|\A[ \n]|[ \n]\z"
_START, _LINE = "\x02", "\n"
_CHUNK, _LARGE_CHUNK = 6_000_000, 20_000_000
_TOGETHER = 32
_ENTRIES = 100_000
_KNOWN = 400_000
# Letters of Latin-1, and small ones.
_LETTERS = r"\A[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+\z"
_SMALL_LETTERS = r"\A[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+\z"
# A letter or digit of the Latin blocks at the end. U+0130 is left out: in small letters it ends in
# a combining dot, which belongs to the mark behind it.
_WORD_END = r"[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]\z"


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, over all its tasks."""
    name = "_quizlake_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def kept_in_worker(key: tuple, make: Callable):
    """What ``make`` gives, kept over tasks. A worker holds one such thing: a new key frees the last."""
    state = worker_state()
    if state.get("key") != key:
        state.pop("value", None)
        give_back()
        state["key"], state["value"] = key, make()
    return state["value"]


class Recent:
    """A bounded memo: two generations, the older dropped when the newer is full.

    ``make`` gives the values of a list of new keys.
    """

    def __init__(self, make: Callable[[list], list], entries: int = _ENTRIES):
        self.make, self.entries, self.young, self.old = make, entries, {}, {}

    def __call__(self, key):
        return self.all([key])[0]

    def all(self, keys: list) -> list:
        values = [*map(self.young.get, keys)]
        absent = [k for k, value in enumerate(values) if value is None]
        if not absent:
            return values
        asked = [keys[k] for k in absent]
        found = dict(zip(asked, map(self.old.get, asked)))
        new = [key for key, value in found.items() if value is None]
        found.update(zip(new, self.make(new) if new else []))
        for k, key in zip(absent, asked):
            values[k] = found[key]
        if len(self.young) + len(found) > self.entries:
            self.old, self.young = self.young, {}
        self.young.update(found)
        return values


class WordTable:
    """Encodings of words, each with the blank before it; ``join`` puts two of them together.

    A word ending in marks is the word and the marks: a letter or digit followed by a mark is a
    place where the tokenizers here always cut.
    """

    def __init__(self, encode: Callable[[list], list], join=operator.add):
        self.encode, self.join = encode, join
        self.line = encode([_LINE])[0]
        self.words, self.marks = Recent(self._words), Recent(encode, 10_000)

    def _words(self, words: list[str]) -> list:
        """Encodings of words as they stand in a cut text: marked, or behind their blank."""
        marked = (_START, _LINE)
        values = self.encode([word[1:] if word[:1] in marked else " " + word for word in words])
        return [self.join(self.line, v) if w[:1] == _LINE else v for w, v in zip(words, values)]

    def of(self, words: pa.Array) -> list:
        stems, ends = _stems(words)
        distinct = stems.dictionary_encode()
        encoded = self.words.all(_strings(distinct.dictionary))
        values = [encoded[k] for k in distinct.indices.to_numpy().tolist()]
        cut = np.flatnonzero(np.asarray(ends))
        if len(cut):
            cut_words, cut_stems = words.take(cut), stems.take(cut)
            tails = [w[len(s) :] for w, s in zip(_strings(cut_words), _strings(cut_stems))]
            for k, tail in zip(cut.tolist(), self.marks.all(tails)):
                values[k] = self.join(values[k], tail)
        return values

    def cut(self, texts: pa.Array, most: int = _CHUNK) -> Iterator[tuple[pa.Array | None, pa.Array, list]]:
        """(offsets, word numbers, encodings) per chunk of texts, in order.

        A chunk holds whole texts of about ``most`` bytes together, or one longer text; texts that are
        not cut come alone with offsets None and their own encoding.
        """
        uneven = np.asarray(pc.match_substring_regex(texts, _UNEVEN))
        sizes = np.asarray(pc.binary_length(texts), np.int64)
        start = 0
        while start < len(texts):
            if uneven[start]:
                yield None, None, self.encode([texts[start].as_py()])
                start += 1
                continue
            stop, held = start, 0
            while stop < len(texts) and not uneven[stop] and (stop == start or held + sizes[stop] <= most):
                held += sizes[stop]
                stop += 1
            chunk = texts.slice(start, stop - start)
            chunk = pc.replace_substring(chunk, _LINE, " " + _LINE)
            chunk = pc.binary_join_element_wise(_START, chunk, "")
            words = pc.split_pattern(chunk, " ")
            numbers = words.flatten().dictionary_encode()
            yield words.offsets, numbers.indices, self.of(numbers.dictionary)
            start = stop

    def ids(self, texts: pa.Array, most: int = _CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, end of each text in them) per chunk; for encodings of 4-byte ids."""
        for offsets, numbers, encodings in self.cut(texts, most):
            flat = np.frombuffer(b"".join(encodings), "<u4")
            if offsets is None:
                yield flat, np.array([len(flat)])
                continue
            lengths = np.fromiter(map(len, encodings), np.int64, len(encodings)) // 4
            starts = np.cumsum(lengths) - lengths
            numbers = np.asarray(numbers)
            taken = lengths[numbers]
            ends = np.cumsum(taken)
            ids = flat[np.repeat(starts[numbers] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.asarray(offsets)[1:] - offsets[0].as_py()
            yield ids, np.concatenate([[0], ends])[bounds]


class BareWords:
    """Ids of texts by a tokenizer that folds case, drops blanks and encodes every word by itself.

    The known words are one Arrow array and their ids one numpy array; the distinct words of a chunk
    are numbered together with them, so only new ones are looked at one by one. Words ending in marks
    are cut as in ``WordTable``. Of more than ``entries`` known words the half used last is kept.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], entries: int = _KNOWN):
        self.encode, self.entries, self.chunks = encode, entries, 0
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, np.int32)
        # Of every known word the place of its ids, how many they are, and the last chunk that had it.
        self.starts, self.lengths, self.used = np.zeros((3, 0), np.int32)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of words; those not known are added."""
        n_known = len(self.known)
        both = pa.concat_arrays([self.known, words]).dictionary_encode()
        numbers, self.chunks = np.asarray(both.indices)[n_known:], self.chunks + 1
        if len(both.dictionary) > n_known:
            flat, lengths = self.encode(both.dictionary.slice(n_known))
            self.known, self.flat = both.dictionary, np.concatenate([self.flat, flat])
            self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
            self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
            self.used = np.concatenate([self.used, np.zeros(len(lengths), np.int32)])
        self.used[numbers] = self.chunks
        return numbers

    def _forget(self) -> None:
        if len(self.known) > self.entries:
            kept = np.sort(np.argsort(-self.used, kind="stable")[: self.entries // 2])
            self.flat = self.flat[_places(self.starts[kept], self.lengths[kept])]
            self.known, self.lengths, self.used = self.known.take(kept), self.lengths[kept], self.used[kept]
            self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has: those of the stem and those of the marks behind it."""
        stems, ends = _stems(words)
        cut = np.flatnonzero(np.asarray(ends))
        marks = pc.replace_substring_regex(words.take(cut), _BEFORE_MARKS, "")
        # Capitals of Latin-1 have one small letter each, as those of ASCII have.
        simple = pc.or_(pc.string_is_ascii(stems), pc.match_substring_regex(stems, _LETTERS))
        numbers = self._numbers(pa.concat_arrays([pc.if_else(simple, pc.utf8_lower(stems), stems), marks]))
        parts = np.zeros((len(words), 2), np.int32)
        parts[:, 0], parts[cut, 1] = numbers[: len(words)], numbers[len(words) :]
        lengths = self.lengths[parts]
        lengths[~np.asarray(ends), 1] = 0
        flat = self.flat[_places(self.starts[parts].ravel(), lengths.ravel())]
        self._forget()
        return flat, lengths.sum(axis=1, dtype=np.int32)

    def ids(self, texts: pa.Array, most: int = _LARGE_CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, end of each text in them) per chunk of whole texts of about ``most`` bytes, or of one longer text."""
        texts = texts.cast(pa.string())
        upto = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        start = 0
        while start < len(texts):
            held = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, held + most, "right")))
            words = pc.split_pattern(pc.replace_substring(texts.slice(start, stop - start), _LINE, " "), " ")
            bounds = np.asarray(words.offsets)
            words = words.flatten().dictionary_encode()
            flat, lengths = self.of(words.dictionary)
            numbers = np.asarray(words.indices)
            taken, starts = lengths[numbers], (np.cumsum(lengths, dtype=np.int32) - lengths)[numbers]
            ends = np.concatenate([[0], np.cumsum(taken, dtype=np.int64)])[bounds[1:] - bounds[0]]
            yield flat[_places(starts, taken)], ends
            start = stop


def _stems(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words without the marks they end in, and which words are cut so: those with a letter or digit before them."""
    stems = pc.utf8_rtrim(words, characters=_MARKS)
    ends = pc.and_(pc.not_equal(stems, words), pc.match_substring_regex(stems, _WORD_END))
    return pc.if_else(ends, stems, words), ends


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places in spans, one span behind the other."""
    places = np.repeat(starts - (np.cumsum(lengths, dtype=np.int32) - lengths), lengths)
    places += np.arange(len(places), dtype=np.int32)
    return places


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    pa.set_cpu_count(1)
    return tokenizer


def library_ids(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids by the ``tokenizers`` library, as little-endian unsigned 32-bit integers."""
    return _ids_by(_library(path))


def _ids_by(tokenizer) -> Callable[[list[str]], list[bytes]]:
    def encode(texts: list[str]) -> list[bytes]:
        return [
            np.array(found.ids, "<u4").tobytes()
            for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    return encode


def _byte_characters() -> str:
    """The characters that stand for the bytes 0 to 255 in the words of byte-level tokenizers."""
    # Bytes that stand for themselves.
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(byte if byte in own else next(others)) for byte in range(0x100))


def marked_ids(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Ids of words and how many each word has, for byte-level tokenizers that mark the last id of a word as such.

    A word of small Latin letters alone is one word to the tokenizer and needs no normalising.
    Such words go through the library many at a time; their marked ends tell them apart.
    """
    whole = _library(path)
    from tokenizers import Tokenizer, pre_tokenizers

    # The same model, without what goes before it.
    alone, joined = _ids_by(whole), Tokenizer(whole.model)
    joined.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("|")
    suffix, characters = whole.model.end_of_word_suffix, _byte_characters()
    ends = np.zeros(whole.get_vocab_size(), bool)
    ends[[number for token, number in whole.get_vocab().items() if token.endswith(suffix)]] = True

    def encode_plain(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.append(np.arange(0, len(words), _TOGETHER), len(words)).astype(np.int32)
        groups = pc.binary_join(pa.ListArray.from_arrays(bounds, words), "|")
        texts = [codecs.charmap_decode(group.encode(), "strict", characters)[0] for group in _strings(groups)]
        found = joined.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(one.ids, np.int32) for one in found)])
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("the tokenizer did not keep to the words")
        return ids, np.diff(stops, prepend=0)

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = np.asarray(pc.match_substring_regex(words, _SMALL_LETTERS))
        others = alone(_strings(words.filter(pa.array(~plain))))
        lengths, ids = np.empty(len(words), np.int64), [np.zeros(0, np.int32)] * 2
        ids[0], lengths[plain] = encode_plain(words.filter(pa.array(plain)))
        ids[1], lengths[~plain] = np.frombuffer(b"".join(others), "<i4"), [len(raw) // 4 for raw in others]
        flat, of_plain = np.empty(int(lengths.sum()), np.int32), np.repeat(plain, lengths)
        flat[of_plain], flat[~of_plain] = ids
        return flat, lengths

    return encode


def spaced_words(path: str) -> WordTable:
    """For byte-level tokenizers of the library, where a blank belongs to the word after it."""
    return WordTable(library_ids(path))


def bare_words(path: str) -> BareWords:
    """For byte-level tokenizers of the library that fold case, drop blanks and mark ends of words."""
    return BareWords(marked_ids(path))
