"""Token ids of whole texts by the tokenizers library, inside tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash

from .shared import mix, text_bytes

_ENCODERS: dict[tuple[str, int], "WordEncoder"] = {}
_SPACES, _DIGITS_LETTERS = b" \t\n\v\f\r", b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PAD = 8
#: Longer words are hashed one by one.
_LONG = 64


def _marks(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


class _Table:
    """Ids of units (by 64-bit hash) in arrays: an open-addressed table of rows, and the rows' stretches of one pool of ids.

    Beyond ``keep`` rows, those leave that were not met again after the run that brought them.
    """

    def __init__(self, keep: int):
        self.keep, self.bits = keep, (2 * keep).bit_length()
        self._clear(np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint32))

    def _clear(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.slots, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.hashes, self.lengths, self.starts, self.again, self.pool = hashes[:0], lengths[:0], np.empty(0, np.int64), np.empty(0, bool), ids[:0]
        self.add(hashes, lengths, ids)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.slots.take(at)
        out = np.where(held == hashes, self.rows.take(at), -1)
        left = np.flatnonzero((held != hashes) & (held != 0))
        while len(left):
            place = at[left] = (at.take(left) + 1) & ((1 << self.bits) - 1)
            held, want = self.slots.take(place), hashes.take(left)
            hit = held == want
            out[left[hit]] = self.rows.take(place[hit])
            left = left[~hit & (held != 0)]
        return out

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new hashes with their ids, one after another."""
        first = len(self.hashes)
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(lengths, dtype=np.int64) - lengths))
        self.hashes, self.lengths, self.pool = np.concatenate((self.hashes, hashes)), np.concatenate((self.lengths, lengths)), np.concatenate((self.pool, ids))
        self.again = np.concatenate((self.again, np.zeros(len(hashes), bool)))
        if 2 * len(self.hashes) > 1 << self.bits:  # one long text may bring more than is kept
            self.bits = (2 * len(self.hashes)).bit_length()
            self.slots, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            first, hashes = 0, self.hashes
        left, at = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = left[self.slots.take(at.take(left)) == 0]
            self.slots[at.take(free)] = hashes.take(free)
            placed = free[self.slots.take(at.take(free)) == hashes.take(free)]
            self.rows[at.take(placed)] = first + placed
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at.take(left) + 1) & ((1 << self.bits) - 1)

    def trim(self) -> None:
        if len(self.hashes) > self.keep:
            stay = np.flatnonzero(self.again)
            if len(stay) > self.keep // 2:
                stay = stay[-self.keep // 2 :]
            self.bits = (2 * self.keep).bit_length()
            self._clear(self.hashes[stay], self.lengths[stay], self.ids(stay))

    def ids(self, rows: np.ndarray) -> np.ndarray:
        lengths = self.lengths.take(rows)
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool.take(np.arange(total) + np.repeat(self.starts.take(rows) - (ends - lengths), lengths))


class WordEncoder:
    """Encodes texts with a tokenizer whose pre-tokens never span white space, and remembers the ids of what it met.

    Ids come from the tokenizers library alone. As it drops white space and never joins across it, a text's ids are
    its words' ids one after another. Where it also ignores case and keeps letters and digits apart from signs, texts
    are put into lower case and a word is two units, what stands before its last signs and those. Texts with ``<``
    may hold an added token, and a letter may become another one with the mark after it: such texts keep their case,
    and a word with ``<`` is one unit. Numpy finds and hashes the units of many texts; those not met before are
    encoded: units of small Latin letters by the tokenizer's model, where probes show what its other steps make of each
    letter, others in one text with an added token between them. Units are told apart by 64-bit hashes. A test compares with whole texts.
    """

    SIGNS = b".,!?;:%"
    #: Bytes of text that are looked up together.
    RUN = 2_000_000

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_file(path), _Table(keep)
        whole, stem, signs = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("Word" + self.SIGNS.decode(), "word", self.SIGNS.decode()))
        self.splits = whole == stem + signs
        probes = ["word", "a", "zyxwvutsrqponmlkjihgfedcba", *(x + y for x in "aeiou" for y in "nrst")]
        self.letters = {ord(c): self.forms(c) for c in map(chr, range(0x180)) if c.isalpha() and c == c.lower()}
        probes += [f"{a}{chr(c)}{b}" for c in self.letters for a, b in (("", ""), ("x", "y"), ("", "é"))]
        # letters that stand as they are, each in one form, whatever is beside them: words of them need the model only
        self.direct = all(self.forms(p) == p.translate(self.letters) and self.tokenizer.encode(p, add_special_tokens=False).ids == self.model_ids(p) for p in probes)
        self.plain_unit = re.compile("[" + "".join(map(chr, self.letters)) + "]+").fullmatch
        self.between = next(((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content.startswith("<")), None)
        self.space, self.sign, self.plain = _marks(_SPACES), _marks(self.SIGNS), _marks(_DIGITS_LETTERS)
        self.masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def prepared(self, text: str | None) -> bytes:
        data = text_bytes(text)
        # the marks that may follow an ASCII letter, U+0300 to U+036F, start with these two bytes
        return data.lower() if self.splits and not (b"<" in data or b"\xcc" in data or b"\xcd" in data) else data

    def units(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units."""
        raw = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(self.space.take(raw).view(np.int8), prepend=1, append=1))
        start, end = edge[::2], edge[1::2]
        if not self.splits or not len(start):
            return start, end
        stem, left = end.copy(), np.arange(len(end))
        while len(left):
            left = left[self.sign.take(raw.take(stem.take(left) - 1))]
            stem[left] -= 1
            left = left[stem.take(left) > start.take(left)]
        two = (stem < end) & (stem > start)
        two &= self.plain.take(raw.take(stem - 1))
        if b"<" in data:
            count = np.concatenate(([0], np.cumsum(raw == 60)))
            two &= count.take(start) == count.take(end)
        which = np.repeat(np.arange(len(start)), 1 + two)
        second = np.concatenate(([False], which[1:] == which[:-1]))
        cut = np.where(two, stem, end)
        return np.where(second, cut.take(which), start.take(which)), np.where(second, end.take(which), cut.take(which))

    def hashed(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes of each unit; ``data`` has _PAD bytes beyond the last."""
        eights = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
        size = end - start
        out = mix(size.astype(np.uint64) ^ eights.take(start) & self.masks.take(np.minimum(size, 8)))
        at, left = 8, np.flatnonzero((size > 8) & (size <= _LONG))
        while len(left):
            out[left] = mix(out.take(left) * np.uint64(0x9E3779B97F4A7C55) ^ eights.take(start.take(left) + at) & self.masks.take(np.minimum(size.take(left) - at, 8)))
            at += 8
            left = left[size.take(left) > at]
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
        out[out == 0] = 1  # 0 marks a free slot
        return out

    def forms(self, text: str) -> str | None:
        """What the model gets of a text; None where that is several pieces."""
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else [(normal, None)]
        return pieces[0][0] if len(pieces) == 1 else None

    def model_ids(self, text: str) -> list[int]:
        return [token.id for token in self.tokenizer.model.tokenize(text.translate(self.letters))]

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(one.ids, np.uint32) for one in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded_together(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, none of which has ``<``."""
        if self.between is None or len(texts) < 2:
            return self.encoded(texts)
        runs, out = [texts[a : a + 256] for a in range(0, len(texts), 256)], []
        for run, ids in zip(runs, self.encoded([self.between[1].join(run) for run in runs]), strict=True):
            cuts = np.flatnonzero(ids == self.between[0])
            if len(cuts) != len(run) - 1:
                out += self.encoded(run)
                continue
            out += [ids[a:b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
        return out

    def learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        text = [u.decode("utf-8", "replace") for u in units]
        plain = [i for i, t in enumerate(text) if self.direct and self.plain_unit(t)]
        rest = set(range(len(units))).difference(plain)
        alone = [i for i in rest if b"<" in units[i]]
        other = sorted(rest.difference(alone))
        texts = lambda which: [text[i] for i in which]
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        got = [[token.id for token in tokenize(t if t.isascii() else t.translate(letters))] for t in texts(plain)]
        more = self.encoded_together(texts(other)) + self.encoded(texts(alone))
        lengths = np.fromiter(map(len, got + more), np.int32, len(units))
        ids = np.concatenate([np.fromiter(chain.from_iterable(got), np.uint32), *more])
        self.table.add(hashes[plain + other + alone], lengths, ids)

    def __call__(self, texts) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; None counts as empty."""
        held, size = [], 0
        for text in texts:
            held.append(self.prepared(text))
            size += len(held[-1])
            if size >= self.RUN:
                yield from self._coded(held)
                held, size = [], 0
        if held:
            yield from self._coded(held)

    def _coded(self, texts: list[bytes]) -> Iterator[bytes]:
        self.table.trim()
        data = b"\n".join(texts) + b"\n" * _PAD
        start, end = self.units(data)
        hashes = self.hashed(data, start, end)
        rows = self.table.find(hashes)
        new = np.flatnonzero(rows < 0)
        self.table.again[rows if not len(new) else rows[rows >= 0]] = True
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            first = new[first]
            self.learn(distinct, [data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
            rows[new] = self.table.find(hashes[new])
        ids = memoryview(self.table.ids(rows).astype("<u4").tobytes())
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        units = np.searchsorted(start, np.cumsum(sizes + 1))  # of each text and those before
        ends = 4 * np.concatenate(([0], np.cumsum(self.table.lengths.take(rows), dtype=np.int64))).take(units)
        return (bytes(ids[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process."""
    key = (path, os.getpid())
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path)
    return _ENCODERS[key]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
