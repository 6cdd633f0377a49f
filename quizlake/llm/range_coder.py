"""Adaptive context-mixing range coder for blocks of token ids, many blocks in lockstep.

A block's model starts empty and learns id by id. Order 2 and order 1 each predict the id last
seen after the same two ids or one id, and remember whether their last two predictions there were
right. Order 0 predicts by the frequencies of the last 4,096 ids of the block, with a share for
ids not among them, which stand in the block as they are. The three are mixed into one arithmetic-coding
interval: how much of it order 2 and order 1 get is what such a state was worth so far in the
block. These shares and the frequencies are counted anew at fixed places.

The steps of one block depend on each other, the blocks do not: numpy advances all blocks
("lanes") by one id at a time.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"ACM3"
_EVERY, _WINDOW = 1024, 4096
_EARLY = (0, 16, 64, 256, 512)
_BITS_1, _BITS_2 = 10, 11
_SEEN = (1 << _BITS_1) + (1 << _BITS_2)
# An interval is cut into 2^18 parts, of which order 0 has at least 2^13; its own cut is 2^13.
_CUT, _LEAST, _SLOT = 18, 13, 13
# Intervals have 24 to 56 bits; 32 of them leave at a time, and a carry waits in bit 56 until then.
_RENORM, _TOP = 1 << 24, 1 << 56
# Bits of the last guess but one and of the last one, for order 1 and order 2.
_OLDER, _NEWER = np.array([[2], [8]], np.int32), np.array([[1], [4]], np.int32)
# Constants as arrays, which numpy takes in sooner than numbers; each step has few blocks and many operations.
_ONE, _FOUR, _FIFTEEN = (np.array(k, np.int32) for k in (1, 4, 15))
_KEY_1, _KEY_2, _SPREAD = (np.array(k, np.int32) for k in ((1 << _BITS_1) - 1, (1 << _BITS_2) - 1, 40503))
_SLOT_BITS, _LAST_SLOT = (np.array(k, np.uint32) for k in (_SLOT, (1 << _SLOT) - 1))
_NOTHING, _HALF, _LOWER, _WHOLE = (np.array(k, np.uint32) for k in (0, 16, 0xFFFF, 1 << _CUT))
_CUT_BITS, _SHORT = np.array(_CUT, np.uint64), np.array(_RENORM, np.uint64)
# Blocks and steps of which a coder foresees the intervals together.
_TOGETHER, _STEPS = 16, 64


class _Model:
    """What the blocks so far say of their next ids; longer blocks come first."""

    def __init__(self, count: int, vocabulary: int, longest: int):
        self.vocabulary, self.counted = vocabulary, 0
        self.kind = np.uint16 if vocabulary < 1 << 16 else np.int32
        self.one = self.two = np.zeros(count, np.int32)
        # The id last seen after a context and whether it was predicted, in bits 0 and 1 for
        # order 1, in bits 2 and 3 for order 2: of every block those after one id, then those after two.
        self.after = np.zeros(count * _SEEN, np.int32)
        self.lane = np.arange(count)
        self.tally = np.zeros(count << 6, np.int64)
        # Of every step and block the state and what had the id: 2 for order 2, 1 for order 1, else 0.
        self.marks = np.zeros((longest, count), np.uint8)
        self.shrink(count)

    def shrink(self, n: int) -> None:
        """Go on with the first ``n`` blocks."""
        self.n, self.one, self.two, self.lane = n, self.one[:n], self.two[:n], self.lane[:n]
        self.row, self.row_1 = self.lane << 4, self.lane * _SEEN
        self.row_2 = self.row_1 + (1 << _BITS_1)
        self.at = np.empty((2, n), np.int64)

    def estimate(self, at_step: int, done: np.ndarray) -> None:
        """Shares and frequencies anew; ``done`` are the ids of every block in the window."""
        n, step = done.shape
        marks = self.marks[self.counted : at_step, :n] + (self.lane << 6)
        self.tally = self.tally[: n << 6] + np.bincount(marks.ravel(), minlength=n << 6)
        self.counted = at_step
        neither, first, second, _ = self.tally.reshape(-1, 4).T
        whole = (neither + first + second) * 8 + 16
        share = (1 << _CUT) - (1 << _LEAST)
        self.share_2 = (share * (second * 8 + 1) // whole).astype(np.uint32)
        self.share_12 = self.share_2 + (share * (first * 8 + 1) // whole).astype(np.uint32)

        # A block's ids in order, then one entry for all ids not seen.
        ranked = np.full((n, step + 1), self.vocabulary, self.kind)
        ranked[:, :step] = done
        ranked[:, :step].sort(axis=1, kind="stable")
        fresh = np.ones((n, step + 2), bool)
        np.not_equal(ranked[:, 1:], ranked[:, :-1], out=fresh[:, 1:-1])
        once = np.count_nonzero(fresh[:, :step] & fresh[:, 1:-1], axis=1)
        distinct = np.count_nonzero(fresh[:, :-1], axis=1)
        at = np.flatnonzero(fresh[:, :-1])
        self.ends = np.cumsum(distinct) - 1
        self.begins = self.ends + 1 - distinct
        slots = 1 << _SLOT
        unseen = np.minimum(slots * (once + 1) // (step + 2) + 1, slots - step)
        sizes = np.diff(at, append=n * (step + 1)).astype(np.uint32)
        sizes *= np.repeat((slots - unseen).astype(np.uint32), distinct)
        sizes //= np.uint32(max(step, 1))
        sizes[self.ends] = 0
        sizes[self.ends] = slots - np.add.reduceat(sizes, self.begins)
        # All blocks' sizes together may leave 32 bits; starts are their sums within a block.
        starts = (np.cumsum(sizes, dtype=np.uint32) - sizes) & np.uint32(slots - 1)
        self.sizes, self.names = sizes, ranked.ravel()[at].astype(np.int32)
        self.entries = (starts << 16) + starts + sizes

    def entries_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the blocks' next ``ids``, a row a step, and whether they are not seen yet, a row a block."""
        found = np.empty(ids.shape, np.uint32)
        table = np.zeros(self.vocabulary + 1, np.uint32)
        begin = 0
        for lane, end in enumerate(self.ends.tolist()):
            names = self.names[begin:end]
            table[names] = self.entries[begin:end]
            table.take(ids[lane], out=found[lane], mode="clip")
            table[names] = 0
            begin = end + 1
        unseen = found == 0
        found = np.where(unseen, self.entries[self.ends][:, None], found)
        return np.ascontiguousarray(found.T), unseen

    def entry_by_slot(self) -> np.ndarray:
        """The entry that each slot of a block lies in, counted from the block's first."""
        own = np.arange(len(self.sizes)) - np.repeat(self.begins, np.diff(self.ends, prepend=-1))
        return np.repeat(own.astype(np.uint16), self.sizes)

    def predict(self) -> None:
        np.add(self.one & _KEY_1, self.row_1, out=self.at[0])
        key = self.one * _SPREAD
        key += self.two
        key &= _KEY_2
        np.add(key, self.row_2, out=self.at[1])
        self.last = self.after.take(self.at, mode="clip")
        self.guesses = self.last >> _FOUR
        self.state = ((self.last[0] | self.last[1]) & _FIFTEEN).astype(np.uint8)
        self.share(self.state)

    def share(self, states: np.ndarray) -> None:
        at = self.row + states
        self.upto_2, self.upto_1 = self.share_2.take(at, mode="clip"), self.share_12.take(at, mode="clip")
        self.rest = _WHOLE - self.upto_1

    def interval(self, entry, right_2, right_1) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the part that the ids have."""
        edges = np.empty((2, *entry.shape), np.uint32)
        start, stop = edges
        np.right_shift(entry, _HALF, out=start)
        np.bitwise_and(entry, _LOWER, out=stop)
        edges *= self.rest
        edges >>= _SLOT_BITS
        edges += self.upto_1
        np.putmask(start, right_1, self.upto_2)
        np.putmask(start, right_2, _NOTHING)
        np.putmask(stop, right_1, self.upto_1)
        np.putmask(stop, right_2, self.upto_2)
        stop -= start
        return start, stop

    def learn(self, step: int, ids, hits, right_2, right_1) -> None:
        seen = self.last << _ONE
        seen &= _OLDER
        seen += ids << _FOUR
        seen += hits * _NEWER
        self.after[self.at] = seen
        mark = self.marks[step, : self.n]
        np.add(self.state, self.state, out=mark)
        mark += right_2.view(np.uint8)
        mark += mark
        mark += right_1.view(np.uint8)
        self.two, self.one = self.one, ids


def _arranged(lengths: np.ndarray):
    order = np.argsort(-lengths, kind="stable")
    return order, lengths[order]


def _places(longest: int) -> dict[int, int]:
    """Steps at which to estimate, each with the next one."""
    places = [place for place in (*_EARLY, *range(_EVERY, longest, _EVERY)) if place < longest]
    return dict(zip(places, [*places[1:], longest]))


def _known_before(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a table under ``keys`` says before every step: whether it guesses right, and the last two outcomes.

    The table holds the id last seen under a key and whether its last two guesses there were right;
    at first it guesses id 0. A row is a block.
    """
    order = np.argsort(keys, axis=1, kind="stable")
    order += (np.arange(len(keys)) * keys.shape[1])[:, None]
    ranked, now = keys.take(order), ids.take(order)
    again = np.zeros(keys.shape, bool)
    again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
    hit = now == 0
    hit[:, 1:] = np.where(again[:, 1:], now[:, 1:] == now[:, :-1], hit[:, 1:])
    once, twice = np.zeros((2, *keys.shape), np.uint8)
    once[:, 1:] = hit[:, :-1] & again[:, 1:]
    twice[:, 1:] = once[:, :-1] & again[:, 1:]
    found = np.empty(keys.size, np.uint8)
    found[order.ravel()] = (hit + (once << 1) + (twice << 2)).ravel()
    found = found.reshape(keys.shape)
    return (found & 1).view(bool), found >> 1


def _foreseen(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every step of every block: states of the contexts, and whether order 2 and order 1 say its id.

    A coder knows all ids beforehand, so what ``_Model.learn`` would have kept is read off the places
    at which a context stood last.
    """
    one, two = np.zeros_like(ids), np.zeros_like(ids)
    one[:, 1:], two[:, 2:] = ids[:, :-1], ids[:, :-2]
    right_1, trust_1 = _known_before((one & ((1 << _BITS_1) - 1)).astype(np.uint16), ids)
    right_2, trust_2 = _known_before(((one * 40503 + two) & ((1 << _BITS_2) - 1)).astype(np.uint16), ids)
    return (trust_2 << 2) + trust_1, right_2, right_1 & ~right_2


def _spelling(vocabulary: int) -> tuple[int, int, int]:
    """Values that an id above its low byte may have, how many of them make one number, bits of the number."""
    values = (vocabulary - 1 >> 8) + 1
    together = max(k for k in range(1, 9) if values**k <= 1 << 64)
    return values, together, (values**together - 1).bit_length()


def _spelled_places(counts: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids in whole units of eight numbers, and the first unit of every block, then of none."""
    units = np.concatenate([[0], np.cumsum(-(-counts // (8 * together)))])
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(units[:-1] * 8 * together - first, counts), units


def _spelled_size(count: int, vocabulary: int) -> int:
    _, together, bits = _spelling(vocabulary)
    return count + -(-(-(-count // together) * bits) // 8)


def _spell(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> list[bytes]:
    """Of every block its ids as they are: low bytes, then what is above them, some together as one number."""
    values, together, bits = _spelling(vocabulary)
    places, units = _spelled_places(counts, together)
    upper = np.zeros((units[-1] * 8, together), np.uint64)
    upper.ravel()[places] = ids >> 8
    numbers = np.zeros(len(upper), "<u8")
    for column in upper.T[::-1]:
        numbers = numbers * np.uint64(values) + column
    parted = np.unpackbits(numbers.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
    packed, low = np.packbits(parted.ravel(), bitorder="little").tobytes(), (ids & 255).astype(np.uint8).tobytes()
    spelled, at = [], 0
    for count, unit in zip(counts.tolist(), (units * bits).tolist()):
        spelled.append(low[at : at + count] + packed[unit : unit + _spelled_size(count, vocabulary) - count])
        at += count
    return spelled


def _read_spelled(spelled: list[bytes], counts: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of all blocks, one block behind the other."""
    values, together, bits = _spelling(vocabulary)
    places, units = _spelled_places(counts, together)
    low = b"".join([data[:count] for data, count in zip(spelled, counts.tolist())])
    upper = b"".join(
        [data[n:].ljust(size, b"\0") for data, n, size in zip(spelled, counts.tolist(), (np.diff(units) * bits).tolist())]
    )
    numbers = np.zeros((units[-1] * 8, 8), np.uint8)
    if bits:
        parted = np.unpackbits(np.frombuffer(upper, np.uint8), bitorder="little").reshape(-1, bits)
        found = np.packbits(parted, axis=1, bitorder="little")
        numbers[:, : found.shape[1]] = found
    numbers = numbers.view("<u8").ravel()
    above = np.empty((len(numbers), together), np.int32)
    for k in range(together):
        above[:, k] = numbers % np.uint64(values)
        numbers //= np.uint64(values)
    return (above.ravel()[places] << 8) + np.frombuffer(low, np.uint8)


def _code(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    lengths = np.array([len(block) for block in blocks])
    order, sizes = _arranged(lengths)
    count, longest = len(blocks), int(sizes[0])
    ids = np.zeros((count, longest), np.int32)
    for lane, k in enumerate(order):
        ids[lane, : lengths[k]] = blocks[k]
    model, places = _Model(count, vocabulary, longest), _places(longest)
    spelled = np.arange(longest) < sizes[:, None]
    # Some blocks at a time, which stay in the processor's cache.
    for lane in range(0, count, _TOGETHER):
        part = slice(lane, lane + _TOGETHER)
        states, right_2, right_1 = _foreseen(ids[part])
        spelled[part] &= ~(right_2 | right_1)
        model.marks[:, part] = ((states << 2) + (right_2.view(np.uint8) << 1) + right_1.view(np.uint8)).T
    low, span = np.zeros(count, np.uint64), np.full(count, _TOP, np.uint64)
    # An id narrows its interval by less than 20 bits: words of 32 bits, behind one that takes no carry.
    width = longest * 5 // 8 + 8
    out, used = np.zeros(count * width, np.uint32), np.arange(count) * width + 1

    def emit(which):
        at, rest = used[which], low[which]
        if len(over := (rest >= _TOP).nonzero()[0]):
            back = at[over]
            while len(back):
                back = back - 1
                out[back] += 1
                back = back[out[back] == 0]
        out[at] = rest >> 24
        used[which] = at + 1
        low[which] = (rest & (_RENORM - 1)) << 32
        span[which] <<= 32

    for first, stop in places.items():
        # Blocks that end inside the stretch are cut off at its steps.
        n = int(np.searchsorted(-sizes, -first, "left"))
        model.shrink(n)
        model.estimate(first, ids[:n, max(0, first - _WINDOW) : first])
        entries, new = model.entries_of(ids[:n, first:stop])
        spelled[:n, first:stop] &= new
        for begin in range(first, stop, _STEPS):
            end = min(begin + _STEPS, stop)
            marks = model.marks[begin:end, : model.n]
            model.share(marks >> 2)
            starts, widths = model.interval(entries[begin - first : end - first], (marks & 2) > 0, (marks & 1) > 0)
            starts, widths = starts.astype(np.uint64), widths.astype(np.uint64)
            for step in range(begin, end):
                while sizes[n - 1] <= step:
                    n -= 1
                row, own_span = step - begin, span[:n]
                own_span >>= _CUT_BITS
                low[:n] += starts[row, :n] * own_span
                own_span *= widths[row, :n]
                if len(which := (own_span < _SHORT).nonzero()[0]):
                    emit(which)
    # Of the interval the one value that ends in 24 zero bits: what follows it is zeros, as behind the words.
    low += _RENORM - 1
    low &= ~np.uint64(_RENORM - 1)
    emit(np.arange(count))
    counts = spelled.sum(axis=1)
    coded: list[bytes] = [b""] * count
    for lane, (k, own) in enumerate(zip(order, _spell(ids[spelled], counts, vocabulary))):
        words = out[lane * width + 1 : used[lane]].astype("<u4")
        coded[k] = np.array(counts[lane], "<u4").tobytes() + own + words.tobytes()
    return coded


def _decode(coded: list[bytes], lengths: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    order, sizes = _arranged(lengths)
    count, longest = len(coded), int(sizes[0])
    counts = np.array([int.from_bytes(coded[k][:4], "little") for k in order])
    begins = [4 + _spelled_size(size, vocabulary) for size in counts.tolist()]
    spelled = _read_spelled([coded[k][4:begin] for k, begin in zip(order, begins)], counts, vocabulary)
    next_spelled = np.cumsum(counts) - counts
    width = max(len(coded[k]) - begin for k, begin in zip(order, begins)) // 4 + 3
    words = np.zeros((count, width), np.uint32)
    for lane, (k, begin) in enumerate(zip(order, begins)):
        got = np.frombuffer(coded[k], "<u4", (len(coded[k]) - begin) // 4, begin)
        words[lane, : len(got)] = got
    model, places = _Model(count, vocabulary, longest), _places(longest)
    # Words as they come in: 24 bits of one and 8 of the next, after the first 56 bits.
    left = (words[:, 0].astype(np.uint64) << 24) | (words[:, 1] >> 8)
    words[:, :-1] = (words[:, :-1] << 24) | (words[:, 1:] >> 8)
    coming, next_word = words.ravel(), np.arange(count) * width + 1
    span = np.full(count, _TOP, np.uint64)
    ids, by_lane, known = np.zeros((longest, count), np.int32), np.zeros((count, longest), model.kind), 0
    first_slot, unseen = np.arange(count) << _SLOT, np.array(vocabulary, np.int32)

    def read(which):
        at = next_word[which]
        left[which] = (left[which] << 32) | coming.take(at, mode="clip")
        next_word[which] = at + 1
        span[which] <<= 32

    for step in range(longest):
        while sizes[model.n - 1] <= step:
            model.shrink(model.n - 1)
        n = model.n
        if step in places:
            by_lane[:, known:step], known = ids[known:step].T, step
            model.estimate(step, by_lane[:n, max(0, step - _WINDOW) : step])
            by_slot = model.entry_by_slot()
            # An entry and its id side by side.
            named = np.column_stack([model.entries, model.names.view(np.uint32)]).view(np.uint64).ravel()
        model.predict()
        own_left, own_span = left[:n], span[:n]
        own_span >>= _CUT_BITS
        value = (own_left // own_span).astype(np.uint32)
        right_2 = value < model.upto_2
        right_1 = (value < model.upto_1) > right_2
        # The last slot that starts at or below the value; where order 0 was not used, any does.
        value -= model.upto_1
        value <<= _SLOT_BITS
        value |= _LAST_SLOT
        value //= model.rest
        slot = np.minimum(value, _LAST_SLOT) + first_slot[:n]
        at = by_slot.take(slot, mode="clip") + model.begins[:n]
        entry, name = named.take(at, mode="clip").view(np.uint32).reshape(n, 2).T
        start, size = model.interval(entry, right_2, right_1)
        own_left -= start * own_span
        own_span *= size
        if len(which := (own_span < _SHORT).nonzero()[0]):
            read(which)
        now = ids[step, :n]
        now[:] = name.view(np.int32)
        np.putmask(now, right_1, model.guesses[0])
        np.putmask(now, right_2, model.guesses[1])
        if len(which := (now == unseen).nonzero()[0]):
            at = next_spelled[which]
            now[which] = spelled.take(at, mode="clip")
            next_spelled[which] = at + 1
        model.learn(step, now, model.guesses == now, right_2, right_1)
    by_lane[:, known:] = ids[known:].T
    decoded: list[np.ndarray] = [by_lane[0, :0]] * count
    for lane, k in enumerate(order):
        decoded[k] = by_lane[lane, : lengths[k]]
    return decoded


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Self-contained blocks: magic, number of ids, checksum of the ids, checksum of the code, code."""
    filled = [k for k, block in enumerate(blocks) if len(block)]
    codes = dict(zip(filled, _code([blocks[k] for k in filled], vocabulary))) if filled else {}
    made = []
    for k, block in enumerate(blocks):
        code = codes.get(k, b"")
        numbers = [len(block), zlib.crc32(np.asarray(block, "<u4").tobytes()), zlib.crc32(code)]
        made.append(MAGIC + np.array(numbers, "<u4").tobytes() + code)
    return made


def decode_blocks(data: list[bytes], vocabulary: int) -> list[np.ndarray]:
    """The ids of each block; raises ValueError if a checksum does not hold."""
    heads = np.array([np.frombuffer(block[4:16], "<u4") for block in data], np.int64).reshape(-1, 3)
    for block, head in zip(data, heads):
        if block[:4] != MAGIC or zlib.crc32(block[16:]) != head[2]:
            raise ValueError("damaged block")
    filled = np.flatnonzero(heads[:, 0])
    found = [np.zeros(0, np.int32)] * len(data)
    if len(filled):
        for k, ids in zip(filled, _decode([data[k][16:] for k in filled], heads[filled, 0], vocabulary)):
            found[k] = ids
    for ids, head in zip(found, heads):
        if zlib.crc32(ids.astype("<u4").tobytes()) != head[1]:
            raise ValueError("block decodes to other ids")
    return found
