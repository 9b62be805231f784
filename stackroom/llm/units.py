"""Byte strings of many texts as codes, in numpy: where words lie in an Arrow column, and a table from strings to codes.

No object is made for a string of up to SHORT bytes: such a string is two numbers, its bytes and its length, and the
table is open-addressed and looked up for all strings of a portion at once. Longer strings go to a dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Longest string that is kept as two numbers: 15 bytes, and one for the length.
SHORT = 15
#: Bytes after the last string that may be read (and are masked away).
PADDING = 16
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
#: White space between words. Fixed values.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def texts_of(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes with PADDING, offsets of the rows in them) for runs of rows of about so many bytes together."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        some = np.zeros(at[stop] - at[row] + PADDING, np.uint8)
        some[:-PADDING] = data[at[row] : at[stop]]
        yield row, some, at[row : stop + 1] - at[row]
        row = stop


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the stretches without white space, and how many words lie before each row and in all."""
    n = int(offsets[-1])
    inside = ~_SPACE[data[:n]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[edges]  # a row starts anew
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops - starts, np.searchsorted(starts, offsets)


def _pair(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 15 bytes and the length (255 at most) of each string, as two numbers."""
    eight = np.ndarray(len(data) - 7, np.uint64, data, 0, (1,))
    low = eight[starts] & _KEEP[np.minimum(sizes, 8)]
    high = eight[np.minimum(starts + 8, len(eight) - 1)] & _KEEP[np.clip(sizes - 8, 0, 7)]
    return low, high | np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)


class Units:
    """Codes 0, 1, ... of byte strings in the order of their first meeting."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.size, self.long = 0, {}
        self._room(1 << 16)

    def __len__(self) -> int:
        return self.size

    def _room(self, slots: int) -> None:
        self.slots, self.shift = slots, np.uint64(64 - slots.bit_length() + 1)
        self.low, self.high, self.code = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.used = 0

    @staticmethod
    def _mix(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _A
        h ^= high * _B
        h ^= h >> np.uint64(29)
        h *= _C
        return h

    def _find(self, low: np.ndarray, high: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Codes, -1 where there is none."""
        out = np.full(len(low), -1, np.int32)
        at = (mixed >> self.shift).astype(np.int64)
        here = self.high[at]
        same = (here == high) & (self.low[at] == low)
        out[same] = self.code[at[same]]
        left = np.flatnonzero(~same & (here != 0))
        while len(left):
            at[left] = (at[left] + 1) & (self.slots - 1)
            here = self.high[at[left]]
            same = (here == high[left]) & (self.low[at[left]] == low[left])
            out[left[same]] = self.code[at[left[same]]]
            left = left[~same & (here != 0)]
        return out

    def _put(self, low: np.ndarray, high: np.ndarray, codes: np.ndarray) -> None:
        """Add strings that are not there and differ."""
        if 3 * (self.used + len(low)) > self.slots:
            held = np.flatnonzero(self.high)
            old = self.low[held], self.high[held], self.code[held]
            self._room(1 << (4 * (self.used + len(low))).bit_length())
            self._put(*old)
        at, left = (self._mix(low, high) >> self.shift).astype(np.int64), np.arange(len(low))
        while len(left):
            free = left[self.high[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.low[at[won]], self.high[at[won]], self.code[at[won]] = low[won], high[won], codes[won]
            lost = np.ones(len(low), bool)
            lost[won] = False
            left = left[lost[left]]
            at[left] = (at[left] + 1) & (self.slots - 1)
        self.used += len(low)

    def codes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each string, and which strings were the first of a new code, by code."""
        low, high = _pair(data, starts, sizes)
        mixed, fresh = self._mix(low, high), []
        out = self._find(low, high, mixed)
        short = sizes <= SHORT
        missing = np.flatnonzero((out < 0) & short)
        while len(missing):
            _, first = np.unique(mixed[missing], return_index=True)
            new = missing[np.sort(first)]
            self._put(low[new], high[new], np.arange(self.size, self.size + len(new), dtype=np.int32))
            self.size += len(new)
            fresh.append(new)
            out[missing] = self._find(low[missing], high[missing], mixed[missing])
            missing = missing[out[missing] < 0]
        later = []
        for i in np.flatnonzero(~short).tolist():
            key = data[starts[i] : starts[i] + sizes[i]].tobytes()
            if (code := self.long.get(key)) is None:
                self.long[key] = code = self.size
                self.size += 1
                later.append(i)
            out[i] = code
        return out, np.concatenate([*fresh, np.array(later, np.int64)]).astype(np.int64)


    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The code of each string, -1 for those that are not there."""
        low, high = _pair(data, starts, sizes)
        out = self._find(low, high, self._mix(low, high))
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self.long.get(data[starts[i] : starts[i] + sizes[i]].tobytes(), -1)
        return out


def hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings, the same in every process."""
    low, high = _pair(data, starts, sizes)
    out = Units._mix(low, high)
    for i in np.flatnonzero(sizes > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return out ^ out >> np.uint64(32)


def shingles(data: np.ndarray, offsets: np.ndarray, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingles of lowered texts, repeats included: so many words in a row, or all of a shorter text."""
    starts, sizes, at = words(data, offsets)
    word = hashes(data, starts, sizes)
    n = np.diff(at)
    count = np.where(n >= words_each, n - words_each + 1, np.minimum(n, 1))
    first = spans(at[:-1], count)
    out = np.full(len(first), np.uint64(words_each))
    left = np.repeat(np.minimum(n, words_each), count)
    for k in range(words_each):
        here = left > k
        out[here] = (out[here] ^ word[first[here] + k]) * _A
        out[here] ^= out[here] >> np.uint64(31)
    return np.repeat(np.arange(len(n)), count), out * _C ^ left.astype(np.uint64)


class Pool:
    """A growing array of numbers, in stretches of given sizes: one for each code."""

    def __init__(self, kind):
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.n = self.end = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.end + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.end : self.end + len(flat)] = flat
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.starts[self.n : self.n + len(sizes)] = self.end + np.cumsum(sizes) - sizes
        self.n, self.end = self.n + len(sizes), self.end + len(flat)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of these codes end to end, and their sizes."""
        sizes = self.sizes[codes]
        return self.flat[spans(self.starts[codes], sizes)], sizes


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0], starts[0] + 1, ... of all stretches end to end."""
    sizes = np.asarray(sizes, np.int64)
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
