"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A word is a longest run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased; it never crosses a text's end.
Words are known by 64-bit hashes. Memory follows the chunk of texts in hand (about 40 bytes for each of its bytes),
never the table; a single text is never cut, so the longest text sets the least chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = values + _STEP
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _lowered_values() -> np.ndarray:
    values = mix(np.arange(1000, 1256, dtype=np.uint64))
    values[65:91] = values[97:123]
    return values


_VALUES = _lowered_values()
_EXACT_VALUES = mix(np.arange(3000, 3256, dtype=np.uint64))
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    def __init__(self) -> None:
        self.size, self.up, self.down = 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > self.size:
            self.size = max(size, 2 * self.size, CHUNK_BYTES + 1)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.full(self.size - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
                self.down = np.concatenate([np.ones(1, np.uint64), np.full(self.size - 1, _INVERSE, np.uint64)]).cumprod(dtype=np.uint64)
        return self.up[:size], self.down[:size]


_POWERS = _Powers()


@dataclass
class Words:
    """Words of the texts `first` to `last` of a batch: word i is the bytes starts[i] to ends[i]; text k has the words
    bounds[k] to bounds[k + 1]."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray  # where each text begins and ends in data
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """Which text of the chunk each word is from."""
        return np.repeat(np.arange(self.last - self.first), self.counts)

    def text(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and ends; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `size` bytes: first, last, their bytes, offsets from 0."""
    data, ends = buffers(column)
    first, n = 0, len(ends) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield first, last, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def words(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Words]:
    for first, last, data, offsets in chunks(column, size):
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            yield Words(first, last, data, offsets, none, none, np.zeros(last - first + 1, np.int64), np.zeros(0, np.uint64))
            continue
        apart = _SEPARATES[data]
        begins = np.ones(n, bool)
        begins[1:] = apart[:-1]
        begins[offsets[:-1][offsets[:-1] < n]] = True
        finishes = np.ones(n, bool)
        finishes[:-1] = begins[1:] | apart[1:]
        starts = np.flatnonzero(begins & ~apart)
        ends = np.flatnonzero(finishes & ~apart) + 1
        up, down = _POWERS.upto(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUES[data] * up, out=sums[1:])
            hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
        yield Words(first, last, data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


@dataclass
class Lines:
    """Lines with any word of the texts `first` to `last`: text k has lines bounds[k] to bounds[k + 1], each with its place
    among all lines of its text, the hash of its bytes between outer white space, and its number of words."""

    first: int
    last: int
    bounds: np.ndarray
    places: np.ndarray
    hashes: np.ndarray
    n_words: np.ndarray
    totals: np.ndarray  # lines of each text, empty ones too


def lines(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Lines]:
    for found in words(column, size):
        k, n = found.last - found.first, len(found.data)
        breaks = np.flatnonzero(found.data == 10)
        # Line number of each word, and lines before each text, both counted over the chunk.
        line = np.searchsorted(breaks, found.starts) + found.owners()
        before = np.searchsorted(breaks, found.offsets) + np.arange(k + 1)
        begins = np.flatnonzero(np.diff(line, prepend=-1))
        last = np.append(begins[1:], len(line)) - 1 if len(line) else begins
        up, down = _POWERS.upto(max(n, 1))
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_EXACT_VALUES[found.data] * up[:n], out=sums[1:])
            start, end = found.starts[begins], found.ends[last]
            hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)
        owner = found.owners()[begins]
        yield Lines(found.first, found.last, np.searchsorted(owner, np.arange(k + 1)), line[begins] - before[owner], hashes, last - begins + 1, np.diff(before))


_MIXERS = mix(np.arange(2000, 2064, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(found: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text as sorted hashes, and the bounds of each text's set.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    counts, total = found.counts, len(found.hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, total - n + 1), np.uint64)
        for i in range(n if total >= n else 0):
            rolled += found.hashes[i:total - n + 1 + i] * _MIXERS[i]
        rolled = mix(rolled)
        sets = []
        for k, count in enumerate(counts):
            at = found.bounds[k]
            if count >= n:
                sets.append(np.unique(rolled[at:at + count - n + 1]))
            elif count:
                sets.append(mix(np.sum(found.hashes[at:at + count] * _MIXERS[:count], keepdims=True) + _MIXERS[32 + count]))
            else:
                sets.append(np.zeros(0, np.uint64))
    bounds = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(x) for x in sets], out=bounds[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def as_signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


class Lookup:
    """Values by distinct 64-bit key: keys in the order of their last bits, and where those of equal last bits begin. It takes
    the bytes of keys and values and 4 to 8 more for each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys & np.int64((1 << max(4, len(keys).bit_length())) - 1), kind="stable")
        keys = keys[order]
        values = values[order]
        del order
        self._hold(keys, values)

    def _hold(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.mask = np.int64((1 << max(4, len(keys).bit_length())) - 1)
        self.begins = np.zeros(int(self.mask) + 2, np.int32 if len(keys) < 1 << 31 else np.int64)
        np.cumsum(np.bincount(keys & self.mask, minlength=int(self.mask) + 1), out=self.begins[1:])

    def __getstate__(self) -> tuple:
        """Each array in bytes of its own, so that a task that reads the table holds little twice."""
        return tuple((zlib.compress(x.tobytes(), 1), x.dtype.str) for x in (self.keys, self.values))

    def __setstate__(self, state: tuple) -> None:
        self._hold(*(np.frombuffer(zlib.decompress(data), kind) for data, kind in state))

    def get(self, keys: np.ndarray, default) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default, self.values.dtype)
        last = keys & self.mask
        end = self.begins[last + 1]
        # Keys of other last bits are never equal, so the first one looked at may be any.
        at = np.minimum(self.begins[last], len(self.keys) - 1)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], default).astype(self.values.dtype, copy=False)
        left = np.flatnonzero((seen != keys) & (at + 1 < end))
        at = at[left] + 1
        while len(left):
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (at + 1 < end[left])
            left, at = left[on], at[on] + 1
        return out
