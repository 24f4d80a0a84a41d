"""Token ids of whole texts: pre-tokens are found and looked up in bulk, the library encodes only new ones.

Texts come as one buffer of bytes. It is cut into units that the word vocabulary's pre-tokenizer never joins, each
unit is told by a 64-bit hash, and a table keeps the ids of the units met so far.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Units whose ids a Python worker keeps (about 60 bytes each); a full table is emptied.
MEMORY = 500_000
#: Longer units get their hash from the whole run of bytes.
LONG_UNIT = 64
#: Text of about so many bytes is worked on at once; a longer text in parts that end at blanks.
PART = 1 << 20
#: Words that the library encodes at a time.
LEARNED = 2000

_SEP, _LETTER, _DIGIT, _SIGN, _END, _WHOLE = range(6)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = _SEP
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_CLASS[128:] = _LETTER
#: Bytes of characters that are no Latin letters, and signs that begin contractions or special tokens.
_HARD = np.zeros(256, bool)
_HARD[list(b"'<") + [0xC2] + list(range(0xCA, 256))] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_END_KEY = np.uint64(0x1B03738712FAD5C9)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers, modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 20), base, np.uint64)
        out[:1] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 byte of each unit, and its class. ``ends`` are the places of the bytes that close texts.

    A unit is a run of letters, a digit, a run of signs, a text's closing byte, or a whole run without blanks where it
    holds signs or characters whose neighbours matter (contractions, special tokens, marks, other scripts).
    """
    kind = _CLASS[data]
    hard = _HARD[data]
    for a, b in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)):  # two signs among the letters, and a letter that falls apart in lower case
        hard[:-1] |= (data[:-1] == a) & (data[1:] == b)
    kind[ends] = _END
    if hard.any():
        blank = (kind == _SEP) | (kind == _END)
        chunk = np.cumsum(blank)
        bad = np.zeros(int(chunk[-1]) + 1, bool)
        bad[chunk[hard & ~blank]] = True
        kind[bad[chunk] & ~blank] = _WHOLE
    new = np.empty(len(kind), bool)
    new[:1] = True
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | (kind[1:] == _END)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(kind))
    which = kind[begin]
    keep = which != _SEP
    return begin[keep], end[keep], which[keep]


def keys_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """64-bit hashes of the units, ASCII letters in lower case, from running sums over the buffer."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LOWER[data] * _powers(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    raw = (sums[end] - sums[begin]) * _powers(_INVERSE, len(data) + 1)[begin]
    raw ^= raw >> np.uint64(32)
    raw *= np.uint64(0x9E3779B97F4A7C15)
    raw ^= raw >> np.uint64(29)
    for k in np.flatnonzero(end - begin > LONG_UNIT).tolist():
        raw[k] = xxhash.xxh3_64_intdigest(data[begin[k] : end[k]].tobytes())
    raw[kind == _END] = _END_KEY
    return np.maximum(raw, np.uint64(1))


class UnitIds:
    """A table from units' hashes to their ids, with places found by the hash."""

    def __init__(self, path: str, end_id: int, memory: int = MEMORY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.memory = end_id, memory
        self._empty(1 << 16)

    def _empty(self, slots: int) -> None:
        self.keys = np.zeros(slots, np.uint64)
        self.first = np.zeros(slots, np.int64)
        self.size = np.zeros(slots, np.int32)
        self.pool = np.zeros(4 * slots, np.uint32)
        self.used = self.count = 0
        self._put(np.array([_END_KEY]), np.array([1]), np.array([self.end_id], np.uint32))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and whether it is there (else the slot is free)."""
        mask = len(self.keys) - 1
        at = (keys >> np.uint64(20)).astype(np.int64) & mask
        got = self.keys[at]
        hit = got == keys
        open_ = np.flatnonzero(~hit & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            got = self.keys[at[open_]]
            hit[open_] = got == keys[open_]
            open_ = open_[(got != keys[open_]) & (got != 0)]
        return at, hit

    def _put(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds keys that are not there yet."""
        if self.used + len(ids) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + len(ids)), np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.count += len(keys)
        self._settle(keys, first, sizes)

    def _settle(self, keys: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (keys >> np.uint64(20)).astype(np.int64) & mask
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[at[rest]] == 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.first[at[won]], self.size[at[won]] = first[won], sizes[won]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & mask

    def _room(self, more: int) -> None:
        if self.count + more > self.memory:
            self._empty(1 << 16)
        slots = len(self.keys)
        while 2 * (self.count + more) > slots:
            slots *= 2
        if slots > len(self.keys):
            full = np.flatnonzero(self.keys)
            keys, first, sizes = self.keys[full], self.first[full], self.size[full]
            self.keys, self.first, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int32)
            self._settle(keys, first, sizes)

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of units; those that are no ``whole`` runs are one pre-token each and go many at a time."""
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        plain = np.flatnonzero(~whole)
        for k in range(0, len(plain), LEARNED):
            some = plain[k : k + LEARNED].tolist()
            got = self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False)
            raw, at = np.array(got.ids, np.uint32), np.array(got.word_ids)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            if len(first) == len(some):
                for i, part in zip(some, np.split(raw, first[1:]), strict=True):
                    ids[i] = part
            else:
                for i in some:
                    ids[i] = np.array(self._direct(words[i]), np.uint32)
        for i in np.flatnonzero(whole).tolist():
            ids[i] = np.array(self._direct(words[i]), np.uint32)
        return np.array([len(x) for x in ids], np.int64), np.concatenate(ids)

    def _slots(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each unit of the buffer, all of them learned, and the unit's first byte."""
        begin, end, kind = units(data, ends)
        keys = keys_of(data, begin, end, kind)
        at, hit = self._places(keys)
        if not hit.all():
            missing = np.flatnonzero(~hit)
            new, where = np.unique(keys[missing], return_index=True)
            self._room(len(new))
            _, there = self._places(new)
            new, where = new[~there], missing[where[~there]]
            if len(new) < len(keys) and self.count == 1:  # the table was emptied: all of the slice is new
                new, where = np.unique(keys, return_index=True)
                keep = new != _END_KEY
                new, where = new[keep], where[keep]
                self._room(len(new))
            raw = data.tobytes()
            words = [raw[a:b].decode(errors="replace") for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)]
            self._put(new, *self._learn(words, kind[where] == _WHOLE))
            at, hit = self._places(keys)
        return at, begin

    def counts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of ids of the texts, each with its end id; one long text is counted part by part."""
        if len(ends) == 1 and len(data) > 2 * PART:
            total, at = 0, 0
            for part in parts_of(data, PART):
                at += len(part)
                total += int(self.size[self._slots(part, ends[:1] - (at - len(part)) if at == len(data) else ends[:0])[0]].sum())
            return np.array([total])
        at, begin = self._slots(data, ends)
        return np.bincount(np.searchsorted(ends, begin), self.size[at], len(ends)).astype(np.int64)

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in turn (each closed by the end id), the first byte of each unit, and its number of ids."""
        at, begin = self._slots(data, ends)
        first, size = self.first[at], self.size[at].astype(np.int64)
        total = np.cumsum(size)
        place = np.repeat(first - (total - size), size)
        place += np.arange(len(place))
        return self.pool[place], begin, size


def parts_of(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in parts of about ``most`` bytes, each ending after a blank or line break."""
    low = 0
    while low < len(data):
        high = low + most
        if high < len(data):
            blank = np.flatnonzero((data[low:high] == 32) | (data[low:high] == 10))
            if not len(blank):
                blank = np.flatnonzero((data[high:] == 32) | (data[high:] == 10))[:1] + most
            high = low + int(blank[-1]) + 1 if len(blank) else len(data)
        yield data[low:high]
        low = high


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, none of them null, and where each text starts and the last ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; a longer row is a range by itself."""
    marks = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


_KEPT: dict[tuple[str, int], UnitIds] = {}


def unit_ids(path: str, end_id: int, memory: int = MEMORY) -> UnitIds:
    """One per Python worker, vocabulary file and end id."""
    key = (path, end_id)
    if key not in _KEPT or _KEPT[key].memory != memory:
        _KEPT[key] = UnitIds(path, end_id, memory)
    return _KEPT[key]
