"""Words, lines and their hashes for whole batches of texts, in numpy.

Arrow hands a batch over as one block of UTF-8 bytes with row bounds. The helpers below work
on that block, a run of rows of about ``CHUNK`` bytes at a time, so memory follows the
longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18

# [\x20\x09-\x0D]: what parts words, unless an operator says otherwise.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLAIN = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
_powers: dict[str, np.ndarray] = {}


class Text(NamedTuple):
    """Rows ``first`` and on of a batch: their bytes, and where each row begins and ends."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


class Words(NamedTuple):
    """Byte ranges of words, and ``bounds``: which words belong to which row."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[Text]:
    """A batch cut into runs of rows; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        to = min(to, len(texts))
        cut = bounds[at : to + 1]
        yield Text(at, whole[cut[0] : cut[-1]], cut - cut[0])
        at = to


def counted(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many are true between each two bounds."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def words(text: Text, white: np.ndarray = WHITE) -> Words:
    inside = ~white[text.data]
    begins, ends = inside.copy(), inside.copy()
    if len(inside):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        inner = text.bounds[(text.bounds > 0) & (text.bounds < len(inside))]
        begins[inner] = inside[inner]
        ends[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, text.bounds))


def lines(text: Text) -> Words:
    """The \\n-split lines of each row, empty ones too; an empty row has one empty line."""
    breaks = np.flatnonzero(text.data == 10)
    starts = np.sort(np.concatenate([text.bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([text.bounds[1:], breaks]), kind="stable")
    per_row = np.diff(np.searchsorted(breaks, text.bounds)) + 1
    return Words(starts, ends, np.concatenate([[0], np.cumsum(per_row)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, by: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        grown = np.full(max(n, CHUNK + (CHUNK >> 2)), by, np.uint64)
        grown[0] = 1
        _powers[name] = np.cumprod(grown, dtype=np.uint64)
    return _powers[name][:n]


def prefix_sums(data: np.ndarray, fold: bool) -> np.ndarray:
    """Running sums from which the hash of any byte range follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    table = _FOLDED if fold else _PLAIN
    np.cumsum(table[data] * _power("up", _BASE, len(data) + 1)[:-1], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they stand."""
    down = _power("down", _INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def even_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """``range_hashes`` of all ranges of ``size`` bytes, by where they begin."""
    n = max(0, len(sums) - size)
    out = sums[size:] - sums[:n]
    out *= _power("down", _INVERSE, len(sums))[:n]
    out += np.uint64(size)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # mix(), in place
        out ^= out >> np.uint64(shift)
        out *= np.uint64(by)
    out ^= out >> np.uint64(31)
    return out


def hashes(text: Text, spans: Words, fold: bool = True) -> np.ndarray:
    """A hash per word or line; with ``fold``, A-Z count as a-z."""
    return range_hashes(prefix_sums(text.data, fold), spans.starts, spans.ends)


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` neighbouring values; the caller drops those across rows."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = values[:n]
    for i in range(1, k):
        out = mix(out * _BASE + values[i : i + n])
    return out


def shingles(values: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row, the hashes of its ``k``-word shingles, repeats included.

    A row of fewer words, but not none, has one shingle: all of them.
    """
    every = windows(values, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(every[a : b - k + 1])
        elif b > a:
            out.append(windows(values[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(every[:0])
    return out


class Lookup:
    """A read-only table from 64-bit keys to positions in ``keys``, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        size = 1 << self.bits
        self.slots = np.full(size, -1, np.int32)
        self.keys = keys
        left, step = np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            at = (self._home(keys[left]) + step) & (size - 1)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several that want a slot the last one stays
            left = left[self.slots[at] != left]
            step += 1
        self.steps = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for keys that are not there."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        slot = self._home(keys)
        got = self.slots[slot]
        hit = (got >= 0) & (self.keys[got] == keys)
        out[hit] = got[hit]
        left = np.flatnonzero(~hit & (got >= 0))
        step = 1
        while len(left):
            got = self.slots[(slot[left] + step) & (len(self.slots) - 1)]
            hit = (got >= 0) & (self.keys[got] == keys[left])
            out[left[hit]] = got[hit]
            left = left[~hit & (got >= 0)]
            step += 1
        return out
