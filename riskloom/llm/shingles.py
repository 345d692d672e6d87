"""Word and shingle hashes of whole texts, many bytes at a time."""

from __future__ import annotations

import numpy as np

SLICE_BYTES = 2**20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_WEIGHTS = np.array(
    [0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F], dtype=np.uint64
)


def _powers(n: int) -> np.ndarray:
    """Base to the powers 0 to n-1, modulo 2**64."""
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slice_hashes(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    first = np.flatnonzero(starts)
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    data, space, first = data[first[0] :], space[first[0] :], first - first[0]
    lengths = np.diff(first, append=len(data))
    inside = np.arange(len(data), dtype=np.int64) - np.repeat(first, lengths)
    longest = int(lengths.max())
    if longest <= len(_POWERS):
        powers = _POWERS
    else:  # white space after a word counts in its length but adds nothing
        powers = _powers(longest)
    return mix(np.add.reduceat(_BYTE[data] * powers[inside], first))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; the text is worked on in slices cut at white space."""
    low = text.lower()
    if len(low) <= SLICE_BYTES:
        return _slice_hashes(np.frombuffer(low, dtype=np.uint8))
    parts, start = [], 0
    while start < len(low):
        end = start + SLICE_BYTES
        while end < len(low) and not _SPACE[low[end]]:
            end += 1
        parts.append(_slice_hashes(np.frombuffer(low[start:end], dtype=np.uint8)))
        start = end
    return np.concatenate(parts)


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; a shorter text is one shingle, an empty one none."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < size:
        whole = (words * _weights(size)[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return mix(np.array([whole], dtype=np.uint64))
    n, weights = len(words) - size + 1, _weights(size)
    total = words[:n] * weights[0]
    for k in range(1, size):
        total = total + words[k : k + n] * weights[k]
    return np.unique(mix(total))


def _weights(size: int) -> np.ndarray:
    if size <= len(_WEIGHTS):
        return _WEIGHTS
    return mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
