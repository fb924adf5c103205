"""Golomb codes with a power of two as divisor (Rice codes) of sorted whole numbers, coded and read as whole arrays."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(bits of a remainder, quotients in unary, remainders) of the gaps between rising different numbers, the first from zero.

    Quotients and remainders lie in two streams, so that both are read without a loop over the numbers.
    """
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    spread = (int(values[-1]) - int(values[0])) // len(values)
    k = max(0, spread.bit_length() - 1)
    high, low = (gaps[1:] >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    unary = np.zeros(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    places = (low[1:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, int(values[0]).to_bytes(8, "little") + np.packbits(unary).tobytes(), np.packbits(places.astype(np.uint8)).tobytes()


def decode(count: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The ``count`` numbers that ``encode`` was given."""
    if not count:
        return np.zeros(0, np.uint64)
    high = np.diff(np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8, offset=8)))[: count - 1], prepend=-1) - 1
    places = np.unpackbits(np.frombuffer(rest, np.uint8), count=(count - 1) * k).reshape(count - 1, k)
    low = (places.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    first = np.array([int.from_bytes(unary[:8], "little")], np.uint64)
    return np.cumsum(np.concatenate((first, (high.astype(np.uint64) << np.uint64(k)) + low)), dtype=np.uint64)
