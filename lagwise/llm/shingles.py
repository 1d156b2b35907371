"""64-bit hashes of words and word shingles of one text, vectorised, in memory bounded by the block and the word count.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased. A word's hash is
a polynomial over random byte values modulo 2**64, mixed; a shingle's combines those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BLOCK = 1 << 20
_rng = np.random.default_rng(20240501)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        both = []
        for step in (_BASE, _INVERSE):
            x = np.full(size, step, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers = both[0], both[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block_words(data: np.ndarray, between: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    solid = ~between[data]
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])

    def hashed(stop: np.ndarray) -> np.ndarray:
        return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))

    if not prefixes:
        return hashed(end), start
    return np.stack([hashed(end), *(hashed(np.minimum(end, start + k)) for k in prefixes)], axis=1), start


def blocks(text: bytes) -> Iterator[tuple[int, int]]:
    """Borders of blocks of some 1 MB, cut at white space."""
    at = 0
    while at < len(text):
        to = min(len(text), at + _BLOCK)
        while to < len(text) and text[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        yield at, to
        at = to


def word_starts(text: bytes, between: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the words of ``text`` in order; bytes marked in ``between`` part words. Long texts go block by block.

    With ``prefixes`` the hashes have a column more for each: that of the word's first so many bytes.
    """
    parts = [_block_words(np.frombuffer(text, np.uint8, to - at, at), between, prefixes) for at, to in blocks(text)] or [_block_words(np.empty(0, np.uint8), between, prefixes)]
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([h for h, _ in parts]), np.concatenate([s + at for (at, _), (_, s) in zip(blocks(text), parts, strict=True)])


def word_hashes(text: bytes) -> np.ndarray:
    return word_starts(text)[0]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, repeats included; with fewer words, of the whole sequence; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    total = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        total = mix(total * _BASE + words[i : i + n])
    return total


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, width))
