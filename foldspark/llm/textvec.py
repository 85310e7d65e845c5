"""Vectorised word hashing over Arrow string batches.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``.  Words are
hashed in blocks of 8 bytes, each mixed in before the next, all words of a chunk at
a time; words of more than ``LONG`` bytes, which are rare, by keyed BLAKE2.  A word of
up to 7 bytes never shares its hash with any other word; longer ones share theirs
with a chance of 2^-64 a pair.  Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are hashed in one go (about 40 bytes of scratch each).
CHUNK_BYTES = 1 << 19

#: Words with more bytes are hashed one by one.
LONG = 256
_KEY = b"foldspark words"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SIZES = (np.arange(LONG + 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
_EIGHT = np.uint64(8 << 56)
_TOP = np.uint64((1 << 64) - (8 << 56))
#: Bytes 0 to n - 1 of a little-endian block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_IDENTITY = np.arange(256, dtype=np.uint8)
_LOWER = _IDENTITY.copy()
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def raw_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = column.cast(pa.large_string()).fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def doc_chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or one longer row each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, off: np.ndarray, outside: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and ``first``: where each row's words begin.
    ``outside`` tells for each byte whether it separates words."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~outside[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def blocks(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """The 8 bytes from each place on, as little-endian integers; zeros follow the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    np.take(_LOWER, buf, out=padded[: len(buf)]) if lower else np.copyto(padded[: len(buf)], buf)
    return np.ndarray(len(buf) + 1, np.uint64, padded, strides=(1,))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of every span of one chunk."""
    return hash_blocks(blocks(buf, lower), starts, ends)


def hash_blocks(by: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same from :func:`blocks` of a chunk; never 0, unless a span is empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    h = by[starts] & _FIRST[np.minimum(size, 8)]
    more = np.flatnonzero(size >= 8)
    # The highest byte is the size of a short word, and 8 or more for others.
    h |= size.astype(np.uint64) << np.uint64(56)
    own = mix(by[starts[more]] * _ODD + _SIZES[np.minimum(size[more], LONG)])
    at, left, to = starts[more] + 8, size[more] - 8, np.arange(len(more))
    if (long := left > LONG - 8).any():
        raw = by.base
        for k in np.flatnonzero(long).tolist():
            own[k] = int.from_bytes(blake2b(raw[starts[more[k]] : ends[more[k]]], digest_size=8, key=_KEY).digest(), "little")
        at, left, to = at[~long], left[~long], to[~long]
    while len(to):
        on = left > 0
        at, left, to = at[on], left[on], to[on]
        own[to] = mix(own[to] + (by[at] & _FIRST[np.minimum(left, 8)]) * _ODD)
        at, left = at + 8, left - 8
    h[more] = own % _TOP + _EIGHT
    return mix(h)


def hashed_words(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, where each row's words begin) by chunk."""
    buf, off = raw_utf8(column)
    for i, j in doc_chunks(off):
        part, rel = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, first = word_spans(part, rel)
        yield i, j, hash_spans(part, starts, ends, lower), first


class HashMap:
    """64-bit hashes to 64-bit integers, at most half full (0 stands for an empty place)."""

    def __init__(self, bits: int = 12):
        self._bits, self._n = bits, 0
        self._keys, self._values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def __len__(self) -> int:
        return self._n

    def _walk(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys >> np.uint64(64 - self._bits)).astype(np.int64), np.arange(len(keys))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the key is there."""
        at, left = self._walk(keys)
        out, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        while len(left):
            held = self._keys[at]
            same = held == keys[left]
            out[left[same]], there[left[same]] = self._values[at[same]], True
            on = ~same & (held != 0)
            left, at = left[on], (at[on] + 1) & ((1 << self._bits) - 1)
        return out, there

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that are not there yet."""
        if 2 * (self._n + len(keys)) > len(self._keys):
            some = self._keys != 0
            old = self._keys[some], self._values[some]
            self.__init__(int(4 * (self._n + len(keys))).bit_length())
            self.add(*old)
        self._n += len(keys)
        at, left = self._walk(keys)
        while len(left):
            free = self._keys[at] == 0
            self._keys[at[free]] = keys[left[free]]  # of several keys for one place, one stays
            won = self._keys[at] == keys[left]
            self._values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self._bits) - 1)
