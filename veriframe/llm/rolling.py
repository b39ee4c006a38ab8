"""Hashes of substrings of a byte array, and of the words and word shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    size = 1 << max(12, n.bit_length())
    if size not in _powers:
        _powers.clear()
        made = []
        for b in (_BASE, _INVERSE):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(b)
            made.append(np.multiply.accumulate(p))
        _powers[size] = tuple(made)
    return _powers[size]


class Hashes:
    """Hashes of all substrings of a byte array, in constant time each."""

    def __init__(self, data: np.ndarray):
        self.forward, self.back = _power(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * self.forward[: len(data)], out=sums[1:])
        self.sums = sums

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes side by side, and where each text begins and ends. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_binary():
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, dtype=np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


#: Bytes that are hashed at a time.
WINDOW = 1 << 18
#: The one-byte white space of ``str.split``; its longer characters as UTF-8.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
_LONG_SPACE = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[c[0] for c in _LONG_SPACE]] = True


def spaces(data: np.ndarray) -> np.ndarray:
    """True for the bytes of white space as ``str.split`` sees it."""
    out = _SPACE[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        at = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.uint32)
        two, three = (at(0) << np.uint32(8)) | at(1), (at(0) << np.uint32(16)) | (at(1) << np.uint32(8)) | at(2)
        for value, n in ((two, 2), (three, 3)):
            found = lead[np.isin(value, [int.from_bytes(c, "big") for c in _LONG_SPACE if len(c) == n]) & (lead + n <= len(data))]
            for k in range(n):
                out[found + k] = True
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (``str.split``) of texts that lie side by side in ``data``, and where each text's words
    begin and end among them."""
    word = ~spaces(data)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True
    before, after = np.append(False, word[:-1]), np.append(word[1:], False)
    first = np.flatnonzero(word & (~before | cut[:-1]))
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    out = np.empty(len(first), dtype=np.uint64)
    k = 0
    while k < len(first):
        last = max(k + 1, int(np.searchsorted(end, first[k] + WINDOW, side="right")))
        part = Hashes(data[first[k] : end[last - 1]])
        out[k:last] = part.of(first[k:last] - first[k], end[k:last] - first[k])
        k = last
    return out, np.searchsorted(first, bounds)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each text (of a shorter text that has words: one run of them all), and
    where each text's runs begin and end among them."""
    words, ends = word_hashes(data, bounds)
    n = np.diff(ends)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.append(0, np.cumsum(count))
    first = np.repeat(ends[:-1] - at[:-1], count) + np.arange(at[-1])  # the first word of each run
    length = np.repeat(np.minimum(n, size), count)
    out = np.zeros(at[-1], dtype=np.uint64)
    for k in range(size):
        step = lambda rows: _scramble(out[rows] * np.uint64(0x9E3779B97F4A7C15) + words[first[rows] + k] + np.uint64(k + 1))  # noqa: E731, B023
        has = np.flatnonzero(length > k)
        if len(has) == len(out):
            has = slice(None)
        out[has] = step(has)
    return out, at
