"""A counting quotient filter over packed word-id n-grams, as sorted numpy arrays.

The bits of an n-gram's ids are permuted invertibly (a Feistel network), which spreads them evenly. The high
bits, the quotient, are not stored: they are the place in the filter, kept as a run length for each quotient.
The remainder holds all other bits, so two n-grams never share a counter and ids come back from the filter.
Entries are in the order of the permuted bits, so filters are merged like sorted runs.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

from riskloom.llm.shingles import mix

_U64 = np.uint64
#: Fixed keys of the permutation's rounds.
_ROUNDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
_HEAD = struct.Struct("<BBBII")
#: A counter is one byte; from this value on it stands in a list of its own.
_LARGE = 255


def half_bits(words: int, id_bits: int) -> int:
    """Bits of each of the two halves that an n-gram is packed into."""
    return (words * id_bits + 1) // 2


def _mask(bits: int) -> np.uint64:
    return _U64(2**bits - 1)


def _shift(x: np.ndarray, bits: int) -> np.ndarray:
    return x << _U64(bits) if bits >= 0 else x >> _U64(-bits)


def pack(ids: Sequence[np.ndarray], id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of n-grams whose k-th words have the ids ``ids[k]``; at most 124 bits together."""
    h = half_bits(len(ids), id_bits)
    left = np.zeros(len(ids[0]), dtype=_U64)
    right = np.zeros(len(ids[0]), dtype=_U64)
    for k, own in enumerate(ids):
        low = (len(ids) - 1 - k) * id_bits  # lowest bit of this id in the whole
        own = own.astype(_U64)
        if low + id_bits > h:
            left |= _shift(own, low - h)
        if low < h:
            right |= _shift(own, low) & _mask(h)
    return left, right


def unpack(left: np.ndarray, right: np.ndarray, words: int, id_bits: int) -> list[np.ndarray]:
    h, out = half_bits(words, id_bits), []
    for k in range(words):
        low = (words - 1 - k) * id_bits
        own = np.zeros(len(left), dtype=_U64)
        if low + id_bits > h:
            own |= _shift(left, h - low)
        if low < h:
            own |= right >> _U64(low)
        out.append(own & _mask(id_bits))
    return out


def permute(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    for key in _ROUNDS:
        left, right = right, left ^ (mix(right + _U64(key)) & _mask(h))
    return left, right


def restore(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    for key in reversed(_ROUNDS):
        left, right = right ^ (mix(left + _U64(key)) & _mask(h)), left
    return left, right


def entries(left: np.ndarray, right: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and for each given key the place of its own."""
    if 2 * h <= 64:
        keys, inverse = np.unique(left << _U64(h) | right, return_inverse=True)
        return keys >> _U64(h), keys & _mask(h), inverse
    order = np.lexsort((right, left))
    one, two = left[order], right[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return one[new], two[new], inverse


def _planes(x: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` of each number in as many whole bytes."""
    width = (bits + 7) // 8
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_planes(data: memoryview, n: int, bits: int) -> tuple[np.ndarray, int]:
    width = (bits + 7) // 8
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data[: n * width], dtype=np.uint8).reshape(n, width)
    return out.view("<u8").ravel().astype(_U64), n * width


def to_bytes(left: np.ndarray, right: np.ndarray, counts: np.ndarray, h: int, shard_bits: int) -> bytes:
    """A filter of distinct ordered keys whose first ``shard_bits`` bits are the same."""
    n = len(left)
    free = h - shard_bits
    q = min(free, max(0, (n - 1).bit_length()))
    quotients = ((left & _mask(free)) >> _U64(free - q)).astype(np.int64)
    runs = np.zeros(n + 2**q, dtype=np.uint8)  # an entry is 0, the end of a quotient's run 1
    runs[np.cumsum(np.bincount(quotients, minlength=2**q)) + np.arange(2**q)] = 1
    large = counts >= _LARGE
    small = np.where(large, _LARGE, counts).astype(np.uint8)
    return b"".join(
        [
            _HEAD.pack(h, shard_bits, q, n, int(large.sum())),
            np.packbits(runs).tobytes(),
            _planes(left & _mask(free - q), free - q),
            _planes(right, h),
            small.tobytes(),
            counts[large].astype("<i8").tobytes(),
        ]
    )


def from_bytes(data: bytes, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of a filter, in order."""
    h, shard_bits, q, n, n_large = _HEAD.unpack_from(data)
    rest = memoryview(data)[_HEAD.size :]
    size = n + 2**q
    runs = np.unpackbits(np.frombuffer(rest[: (size + 7) // 8], dtype=np.uint8), count=size)
    rest = rest[(size + 7) // 8 :]
    quotients = np.cumsum(runs)[runs == 0].astype(_U64)
    free = h - shard_bits
    low, used = _from_planes(rest, n, free - q)
    rest = rest[used:]
    right, used = _from_planes(rest, n, h)
    rest = rest[used:]
    counts = np.frombuffer(rest[:n], dtype=np.uint8).astype(np.int64)
    counts[counts == _LARGE] = np.frombuffer(rest[n : n + 8 * n_large], dtype="<i8")
    return _U64(shard << free) | quotients << _U64(free - q) | low, right, counts


def merge(filters: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], h: int):
    """Distinct keys and summed counts of several filters, and for each filter the places of its entries."""
    left, right, inverse = entries(*(np.concatenate([f[i] for f in filters]) for i in (0, 1)), h)
    totals = np.zeros(len(left), dtype=np.int64)
    np.add.at(totals, inverse, np.concatenate([f[2] for f in filters]))
    return left, right, totals, np.split(inverse, np.cumsum([len(f[0]) for f in filters])[:-1])
