"""Hashes of words and of runs of words, computed over many texts at once inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed together.
TEXT_BYTES = 1 << 20
_BLANK = bytes(32 if chr(c) in " \t\n\x0b\f\r" else c for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in _BLANK)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of other bytes than the six ASCII blanks), one text after another, and the number
    of words of each text."""
    joined = b" ".join(texts).translate(_LOWER if lower else _BLANK)
    a = np.frombuffer(joined, np.uint8)
    word = a != 32
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.arange(len(a)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(a)]))))
    powers = np.full(int(place.max()) + 1, _BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    values = (a.astype(np.uint64) + np.uint64(1)) * powers[place]
    values[~word] = 0
    ends = np.cumsum([len(t) + 1 for t in texts])
    return _finish(np.add.reduceat(values, starts)), np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words, by its first word; empty if there are fewer words. A run of a + b words is
    put together from runs of a and of b words, so log(width) steps do."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, have, power, size, step = None, 0, hashes, 1, int(_STEP)
    while True:
        factor = np.uint64(step)
        if width & size:
            total = power[:n] if total is None else total[:n] * factor + power[have : have + n]
            have += size
        if 2 * size > width:
            return _finish(total)
        power = power[:-size] * factor + power[size:]
        size, step = 2 * size, step * step % (1 << 64)


def hashed_texts(batches: Iterator[pa.RecordBatch], column: int, lower: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the word hashes of their texts and the number of words of each; a null text has none."""
    for batch in batches:
        begin, texts, size = 0, [], 0
        for k, text in enumerate(batch.column(column)):
            text = text.as_py()
            texts.append(text.encode("utf-8", "surrogatepass") if text else b"")
            size += len(texts[-1])
            if size >= TEXT_BYTES or k == batch.num_rows - 1:
                yield batch.slice(begin, len(texts)), *hash_words(texts, lower)
                begin, texts, size = k + 1, [], 0


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted different shingle hashes; with fewer words the whole sequence is one; without words none."""
    every, end = runs(hashes, width), 0
    for n in counts.tolist():
        start, end = end, end + n
        if 0 < n < width:
            yield runs(hashes[start:end], n) ^ np.uint64(n)
        else:
            yield np.unique(every[start : max(start, end - width + 1)])
