"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block is cut into lanes of STEPS ids that are coded side by side: step t codes the t-th id of every lane, after which
one model, shared by the lanes, learns all of them. Three orders predict an id: what mostly followed the two ids before
it (order 2: one successor), what mostly followed the one before it (order 1: two successors), and how often each id has
come so far (order 0, where an unseen id counts 1/32). An id's probability is the mixture

    l2 [id = successor of order 2] + l1 [id = first of order 1] + l1' [id = second of order 1] + l0 P0(id | none of these)

with weights learnt for each joint state of the successors' confidences, as often as each order was right in it. Of a
lane's first ids nothing is before. Numpy does a step for all lanes at once; the arithmetic is on integers and single
IEEE divisions, so that a reader on another machine repeats it.
"""

from __future__ import annotations

import zlib

import numpy as np

STEPS = 256  # ids a lane
BLOCK = 8192 * STEPS  # ids a block
PAIRS = 18  # bits of a pair's place in the table of order 2
_UNIT = np.uint64(38)  # bits of the mixture's mass
_WHOLE = 1 << 38
_ADD = 32  # order 0: what a sighting adds to an id's initial 1
_BUCKETS = 15  # bits of the index into order 0
_CONF, _MOST = 3, 7  # successors are id << _CONF | confidence, which is 0 only where there is none
_STATES = 8 * 8 * 8 * 3
_TOP, _16, _48 = np.uint64(1 << 47), np.uint64(16), np.uint64(48)


class _Model:
    """What a block has taught so far. ``predict`` and ``learn`` alternate, for writer and reader alike."""

    def __init__(self, vocabulary: int, lanes: int):
        self.none = vocabulary  # the id that stands for nothing; order 0 gives it no part
        empty = np.int64(vocabulary << _CONF)
        self.one, self.two = np.full(vocabulary + 1, empty << 32 | empty, np.int64), np.full(1 << PAIRS, empty, np.int32)
        self.counts, self.pending = np.zeros(vocabulary, np.int64), []
        state = np.arange(_STATES)
        same, second, first, two = state % 3, state // 3 % 8, state // 24 % 8, state // 192
        # a weight starts with its confidence; none where the successor is missing or stands in another place
        self.right = np.stack((two * 1.0, first * 0.5 * (same != 1), second * 0.25 * (same != 2), np.full(_STATES, 2.0)), axis=1)
        self.last, self.pair, self.step = np.full(lanes, self.none, np.int64), np.zeros(lanes, np.int64), 0

    def refresh(self) -> None:
        """Take what was learnt into order 0 and the weights: each step at first, then every sixteenth."""
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=self.none)
            self.pending = []
        freq = _ADD * self.counts + 1
        before = np.concatenate(([0], np.cumsum(freq)))
        self.total, self.before = int(before[-1]), before
        self.freq = np.append(freq, 0).astype(np.int32)
        self.spans = before << 32 | self.freq  # where an id begins, and its frequency
        self.index = None
        share = self.right / (self.right[:, 0] + self.right[:, 1] + self.right[:, 2] + self.right[:, 3])[:, None]
        sizes = (share[:, :3] * float(_WHOLE - (_WHOLE >> 9))).astype(np.int64)
        ends = np.cumsum(sizes, axis=1)
        self.starts = np.concatenate((np.zeros((_STATES, 1), np.int64), ends), axis=1)
        self.sizes = np.concatenate((sizes, _WHOLE - ends[:, 2:]), axis=1)

    def found(self, into: np.ndarray) -> np.ndarray:
        """The id whose part of order 0 holds each value."""
        if self.index is None:
            self.shift = max(0, self.total.bit_length() - _BUCKETS)
            starts = self.before[:-1] + (1 << self.shift) - 1 >> self.shift
            self.index = np.cumsum(np.bincount(starts, minlength=(self.total >> self.shift) + 2)) - 1
        into = np.minimum(into, self.total - 1)  # only where bytes were damaged
        some = self.index.take(into >> self.shift)
        for _ in range(3):
            later = self.before.take(some + 1) <= into
            if not later.any():
                return some
            some += later
        left = np.flatnonzero(self.before.take(some + 1) <= into)
        some[left] = np.searchsorted(self.before, into.take(left), side="right") - 1
        return some

    def predict(self, n: int) -> None:
        """Successors of the first n lanes' contexts and their joint state."""
        if self.step < 12 or not self.step & 15:
            self.refresh()
        self.at2, self.at1 = self.pair[:n], self.last[:n]
        self.e2 = self.two.take(self.at2)
        pairs = self.one.take(self.at1)
        self.ea, self.eb = (pairs >> 32).astype(np.int32), pairs.astype(np.int32)
        self.c2, self.ca, self.cb = self.e2 >> _CONF, self.ea >> _CONF, self.eb >> _CONF
        self.f2, self.fa, self.fb = self.e2 & _MOST, self.ea & _MOST, self.eb & _MOST
        same_a, same_b = self.ca == self.c2, self.cb == self.c2
        self.state = ((self.f2 * 8 + self.fa) * 8 + self.fb) * 3 + same_a + 2 * (same_b & ~same_a)
        self.places = [self.c2, np.where(same_a, self.none, self.ca), np.where(same_b, self.none, self.cb)]

    def learn(self, n: int, ids: np.ndarray, place: np.ndarray) -> None:
        """``place``: four times the state, plus which of the mixture's four parts coded each id."""
        self.pending.append(ids)
        self.right += np.bincount(place, minlength=4 * _STATES).reshape(_STATES, 4)
        new = ids << _CONF | 1
        up2 = self.e2 + (self.f2 < _MOST)
        down2 = np.where(self.f2 > 1, self.e2 - (self.f2 + 1 >> 1), new)
        self.two[self.at2] = np.where(self.c2 == ids, up2, down2)
        is_a, is_b = self.ca == ids, self.cb == ids
        miss = ~(is_a | is_b)
        worn = miss & (self.fb <= 1)
        b = np.where(worn, new, self.eb + (is_b & (self.fb < _MOST)) - (miss & (self.fb > 1)))
        a = self.ea + (is_a & (self.fa < _MOST)) - (worn & (self.fa > 1))
        swap = (b & _MOST) > (a & _MOST)
        high, low = np.where(swap, b, a), np.where(swap, a, b)
        self.one[self.at1] = high.astype(np.int64) << 32 | low
        mixed = self.last[:n] * 0x9E3779B1 + ids * np.int64(0x85EBCA6B)
        self.pair[:n] = (mixed ^ mixed >> 15) & ((1 << PAIRS) - 1)
        self.last[:n] = ids
        self.step += 1


class _Writer:
    """Range coder over 64-bit registers that moves 16 bits at a time, for many lanes; carries go into words already written."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 63, np.uint64)
        self.out, self.n = np.zeros((lanes, 64), "<u2"), np.zeros(lanes, np.int64)

    def put(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        """Narrow the first n lanes."""
        low, width = self.low[:n], self.range[:n]
        unit = width >> _UNIT
        add = unit * start.astype(np.uint64)
        low += add
        self.carry(np.flatnonzero(low < add))
        np.multiply(unit, size.astype(np.uint64), out=width)
        at = np.flatnonzero(width < _TOP)
        while len(at):
            self.move(at)
            width[at] <<= _16
            at = at[width.take(at) < _TOP]

    def carry(self, at: np.ndarray) -> None:
        place = self.n.take(at) - 1
        while len(at):
            self.out[at, place] += np.uint16(1)
            over = self.out[at, place] == 0
            at, place = at[over], place[over] - 1

    def move(self, at: np.ndarray) -> None:
        place = self.n.take(at)
        if place.max() + 4 > self.out.shape[1]:
            self.out = np.concatenate((self.out, np.zeros_like(self.out)), axis=1)
        low = self.low.take(at)
        self.out[at, place] = low >> _48
        self.low[at] = low << _16
        self.n[at] = place + 1

    def finish(self) -> bytes:
        """Each lane's number of words, deflated, then all words. A reader takes what is missing at a lane's end as zeros."""
        # the range is 2^47 at least: the next multiple of 2^47 lies in it, and has two words
        half = np.uint64((1 << 47) - 1)
        add = (half - ((self.low - np.uint64(1)) & half)) & half
        self.low += add
        at = np.arange(len(self.n))
        self.carry(np.flatnonzero(self.low < add))
        for _ in range(2):
            self.move(at)
        counts = zlib.compress(self.n.astype("<u2").tobytes())
        words = self.out[np.arange(self.out.shape[1]) < self.n[:, None]]
        return len(counts).to_bytes(4, "little") + counts + words.tobytes()


class _Reader:
    def __init__(self, data: bytes, lanes: int):
        size = 4 + int.from_bytes(data[:4], "little")
        counts = np.frombuffer(zlib.decompress(data[4:size]), "<u2").astype(np.int64)
        self.words = np.zeros((lanes, int(counts.max()) + 5), "<u2")
        self.words[np.arange(self.words.shape[1]) < counts[:, None]] = np.frombuffer(data, "<u2", offset=size)
        self.into, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 63, np.uint64)
        for i in range(4):
            self.into = self.into << _16 | self.words[:, i]
        self.flat = self.words.reshape(-1)
        self.at = np.arange(lanes) * self.words.shape[1] + 4
        self.end = self.at - 5 + self.words.shape[1]  # a zero beyond each lane's words

    def value(self, n: int) -> np.ndarray:
        """Where in the whole mass the first n lanes stand."""
        self.unit = self.range[:n] >> _UNIT
        return np.minimum(self.into[:n] // self.unit, np.uint64(_WHOLE - 1)).astype(np.int64)

    def take(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        into, width = self.into[:n], self.range[:n]
        into -= self.unit * start.astype(np.uint64)
        np.multiply(self.unit, size.astype(np.uint64), out=width)
        at = np.flatnonzero(width < _TOP)
        while len(at):
            place = self.at.take(at)
            into[at] = into.take(at) << _16 | self.flat.take(place)
            self.at[at] = np.minimum(place + 1, self.end.take(at))
            width[at] <<= _16
            at = at[width.take(at) < _TOP]


def _shape(n: int) -> tuple[int, np.ndarray]:
    """Lanes of a block of n ids, and how many of them have an id at each step."""
    lanes = -(-n // STEPS)
    active = np.full(min(n, STEPS), lanes)
    active[n - STEPS * (lanes - 1) :] = lanes - 1
    return lanes, active


def _encode(ids: np.ndarray, vocabulary: int) -> bytes:
    lanes, active = _shape(len(ids))
    wide = np.zeros(lanes * STEPS, np.int32)
    wide[: len(ids)] = ids
    wide = np.ascontiguousarray(wide.reshape(lanes, STEPS).T)
    model, coder = _Model(vocabulary, lanes), _Writer(lanes)
    for t, n in enumerate(active.tolist()):
        one = wide[t, :n]
        model.predict(n)
        c2, ca, cb = model.places
        part = np.where(c2 == one, 0, np.where(ca == one, 1, np.where(cb == one, 2, 3)))
        place = model.state * 4 + part
        start, size = model.starts.take(place), model.sizes.take(place)
        rest = part == 3
        span, low = model.spans.take(one), np.int64(0xFFFFFFFF)
        g2, ga, gb = (model.freq.take(c) for c in model.places)  # what order 0 leaves out
        before = (span >> 32) - (g2 * (c2 < one) + ga * (ca < one) + gb * (cb < one))
        scale = (size / np.maximum(model.total - (g2 + ga + gb), 1)).astype(np.int64)
        start += before * scale * rest
        np.copyto(size, (span & low) * scale, where=rest)
        coder.put(n, start, size)
        model.learn(n, one, place)
    return coder.finish()


def _decode(data: bytes, count: int, vocabulary: int) -> np.ndarray:
    lanes, active = _shape(count)
    model, coder = _Model(vocabulary, lanes), _Reader(data, lanes)
    wide, low = np.zeros((STEPS, lanes), np.int32), np.int64(0xFFFFFFFF)
    for t, n in enumerate(active.tolist()):
        model.predict(n)
        value, edges = coder.value(n), model.starts.take(model.state, axis=0)
        part = (value >= edges[:, 1]).astype(np.int64) + (value >= edges[:, 2]) + (value >= edges[:, 3])
        place = model.state * 4 + part
        start, size = model.starts.take(place), model.sizes.take(place)
        one = np.where(part == 0, model.c2, np.where(part == 1, model.ca, model.cb))
        at = np.flatnonzero(part == 3)
        rest = size.take(at)
        a, b, c = (model.spans.take(p.take(at)) for p in model.places)
        scale = (rest / np.maximum(model.total - (a & low) - (b & low) - (c & low), 1)).astype(np.int64)
        into = ((value.take(at) - start.take(at)) / np.maximum(scale, 1)).astype(np.int64)
        # past the ids that order 0 leaves out, in their order
        a, b = np.minimum(a, b), np.maximum(a, b)
        b, c = np.minimum(b, c), np.maximum(b, c)
        a, b = np.minimum(a, b), np.maximum(a, b)
        passed = np.zeros(len(at), np.int64)
        for span in (a, b, c):
            passed += (span & low) * (into + passed >= span >> 32)
        into += passed
        some = model.found(into)
        span = model.spans.take(some)
        start[at] += ((span >> 32) - passed) * scale
        size[at] = (span & low) * scale
        one[at] = some
        coder.take(n, start, size)
        wide[t, :n] = one
        model.learn(n, one, place)
    return wide.T.reshape(-1)[:count]


def encode_blocks(ids: np.ndarray, vocabulary: int) -> list[tuple[int, int, bytes]]:
    """(ids, crc32 of the ids as little-endian 32-bit integers, coded bytes) of each block."""
    raw = np.ascontiguousarray(ids, "<u4")
    parts = [raw[a : a + BLOCK] for a in range(0, len(raw), BLOCK)]
    return [(len(p), zlib.crc32(p), _encode(p, vocabulary)) for p in parts]


def decode_blocks(blocks: list[tuple[int, int, bytes]], vocabulary: int) -> np.ndarray:
    """The ids of any blocks, in their order; a block that is damaged or whose checksum fails raises ValueError."""
    out: list[np.ndarray] = []
    for n, crc, coded in blocks:
        try:
            one = _decode(coded, n, vocabulary).astype("<u4")
        except (zlib.error, IndexError) as e:
            raise ValueError("a block is damaged") from e
        if zlib.crc32(one) != crc:
            raise ValueError("a block does not match its checksum")
        out.append(one)
    return np.concatenate(out) if out else np.empty(0, "<u4")
