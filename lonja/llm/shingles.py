"""Sets of word shingles as sorted 64-bit hashes, vectorised over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time (arrays of eight bytes for each), and the odd base of the polynomial with its inverse.
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: A random value for each byte, the same for A-Z and a-z.
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_VALUE[65:91] = _VALUE[97:123]
_POWER = _powers(_BASE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64))
_PLACE = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word in a byte array, and its hash; words are split at white space, A-Z count as a-z."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        if end < len(data):  # cut at white space; a longer word is hashed as one below
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            while not len(gaps) and end < len(data):
                end = min(len(data), end + _PIECE)
                gaps = np.flatnonzero(_SPACE[data[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        piece = data[at:end]
        word = np.concatenate(([False], ~_SPACE[piece], [False]))
        edges = np.flatnonzero(word[1:] != word[:-1])
        first, last = edges[::2], edges[1::2]
        if len(piece) <= _PIECE:
            total = np.concatenate(([np.uint64(0)], np.cumsum(_VALUE[piece] * _POWER[: len(piece)], dtype=np.uint64)))
            h = (total[last] - total[first]) * _INVERSE[first]
        else:  # it holds a word of over a megabyte
            h = np.array([_long(piece[a:b]) for a, b in zip(first, last)], np.uint64)
        starts.append(first + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), mixed(np.concatenate(hashes))


def _long(word: np.ndarray) -> int:
    out = 0
    for at in range(0, len(word), _PIECE):
        part = word[at : at + _PIECE]
        out += int((_VALUE[part] * _POWER[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return out % (1 << 64)


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row stands alone."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """The distinct n-word shingles of each text of a string array, ascending. Words are lower-cased in A-Z only; a
    text of fewer words is one shingle; null texts and texts without words have an empty set."""
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    for a, b in _runs(ends, _PIECE):
        cuts = ends[a : b + 1]
        own = data[cuts[0] : cuts[-1]]
        if b - a > 1:  # a word never spans two texts: a space between them
            own = np.insert(own, cuts[1:-1] - cuts[0], 32)
            cuts = cuts - cuts[0] + np.concatenate((np.arange(b - a), [b - a - 1]))
        else:
            cuts = cuts - cuts[0]
        starts, w = word_hashes(own)
        first = np.searchsorted(starts, cuts)
        h = np.empty(0, np.uint64)
        if len(w) >= n:
            h = w[: len(w) - n + 1] * _PLACE[0]
            for k in range(1, n):
                h += w[k : len(w) - n + 1 + k] * _PLACE[k % len(_PLACE)] * np.uint64(2 * (k // len(_PLACE)) + 1)
            h = mixed(h)
        for k in range(b - a):
            lo, hi = int(first[k]), int(first[k + 1])
            if hi - lo >= n:
                s = np.sort(h[lo : hi - n + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif hi > lo:
                yield mixed((w[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo))
            else:
                yield np.empty(0, np.uint64)
