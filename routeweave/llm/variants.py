"""Operator 11: spelling variant grouping by Bloom-guided neighbourhoods.

1. Words are counted inside tasks, in tables of ``HELD_WORDS`` entries, and summed by a shuffle; frequent ones are the vocabulary.
2. Blocked Bloom filters (256-bit blocks, one bit in each of eight lanes, ``BITS_PER_WORD`` bits a word) are built by executors for shards of the vocabulary
   by length and hash, ``SHARD_WORDS`` words each on average. They are broadcast in passes of at most ``FILTER_BYTES``; a larger vocabulary
   takes more passes, never a larger or fuller filter.
3. Each word's edits (one code point deleted, or replaced by a later one of the alphabet) are hashed at once from a rolling
   polynomial, without being written out, and probed. Both are enough: of two words that differ by an inserted code point one is a
   deletion of the other, and of two that differ by a replaced one exactly one has the earlier code point.
4. Only edits that a filter knows become rows, and an exact join with the vocabulary removes the false ones. A word has at most one
   row for each of its edits.
5. A word's form is its near word of largest count, if that is ``ratio`` times its own. Counts rise by that factor along forms, so
   roots are found by doubling in a few rounds.

Defined cases: null or empty texts have no words; a null doc_id counts as the text ``null`` when misspellings are drawn; ties of forms go to the smallest word; repeated rows count
each; words and texts of any length are handled, long words by blocks of their places; an empty table or vocabulary yields no rows;
extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Words that a task counts before it emits them.
HELD_WORDS = 500_000
#: A filter's words and bits a word, and bytes of filters broadcast at once.
SHARD_WORDS, BITS_PER_WORD, FILTER_BYTES = 1 << 18, 16, 1 << 25
#: Words of this length or more share their shards.
LONGEST = 64
#: Code points that words are made of after lower-casing A to Z.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.int64)
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Edits hashed at once.
EDITS = 1 << 20
_LANES = 8
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def corpus_words(docs: DataFrame, min_chars: int = MIN_CHARS, every: int | None = None, held: int = HELD_WORDS) -> DataFrame:
    """(word, n): runs of letters with A to Z lower-cased, at least ``min_chars`` long, with their occurrences. ``every``: a run loses code point
    h % length where ``every`` divides h, the CRC-32 of ``doc_id:run`` (misspellings drawn for a test)."""
    run = re.compile("[a-zÀ-ÿ]{%d,}" % min_chars)
    source = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")).cast("binary"))

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = Counter(run.findall(text.translate(_LOWERED).decode("utf-8", "replace")))
                if every:
                    begun, changed = crc32(f"{doc_id}:".encode()), []
                    for word in counts:
                        h = crc32(word.encode(), begun)
                        if h % every == 0:
                            changed.append((word, h % len(word)))
                    for word, at in changed:
                        total[word[:at] + word[at + 1 :]] += counts.pop(word)
                total.update(counts)
                if len(total) > held:
                    yield rows(total)
                    total = Counter()
        if total:
            yield rows(total)

    summed = source.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return summed.filter(F.char_length("word") >= min_chars)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a word in each row."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _mixed(sums: np.ndarray, length: int) -> np.ndarray:
    h = sums + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


class Shards:
    """The filters' layout: of each length class the slices by hash, and the blocks of each of its slices."""

    def __init__(self, counts: dict[int, int], shard_words: int = SHARD_WORDS):
        self.first, self.slices, self.blocks, n = {}, {}, {}, 0
        for size, words in sorted(counts.items()):
            self.first[size], self.slices[size] = n, -(-words // shard_words)
            self.blocks[size] = max(1, -(-words * BITS_PER_WORD // (self.slices[size] * 32 * _LANES)))
            n += self.slices[size]
        self.bytes = [self.blocks[size] * 4 * _LANES for size in sorted(counts) for _ in range(self.slices[size])]

    def of(self, length: int, h: np.ndarray) -> np.ndarray | None:
        size = min(length, LONGEST)
        if size not in self.first:
            return None
        return self.first[size] + ((h & np.uint64(0xFFFF)) % np.uint64(self.slices[size])).astype(np.int64)

    def block(self, length: int, h: np.ndarray) -> np.ndarray:
        return (((h >> np.uint64(32)) * np.uint64(self.blocks[min(length, LONGEST)])) >> np.uint64(32)).astype(np.int64)

    def passes(self, most: int = FILTER_BYTES) -> list[list[int]]:
        """Shards whose filters are broadcast together."""
        out, size = [], most
        for shard, n in enumerate(self.bytes):
            if size + n > most:
                out.append([])
                size = 0
            out[-1].append(shard)
            size += n
        return out


def _lane_bits(h: np.ndarray, lane: int) -> np.ndarray:
    low = (h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
    return np.uint64(1) << (((low * np.uint64((_BASE >> 32) * (2 * lane + 1) | 1)) >> np.uint64(27)) & np.uint64(31))


def _filters(vocabulary: DataFrame, shards: Shards) -> DataFrame:
    """(shard, bits) of every shard, built on the executors."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for size, at in _by_length(words):
                points = _points([words[i] for i in at])
                h = _mixed((points * _powers(size)[:-1]).sum(axis=1, dtype=np.uint64), size)
                columns = [shards.of(size, h), shards.block(size, h), h.view(np.int64), np.full(len(h), min(size, LONGEST))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["shard", "block", "h", "size"])

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bits = np.zeros((shards.blocks[table.column("size")[0].as_py()], _LANES), np.uint32)
        block, h = table.column("block").to_numpy(), table.column("h").to_numpy().view(np.uint64)
        for lane in range(_LANES):
            np.bitwise_or.at(bits[:, lane], block, _lane_bits(h, lane).astype(np.uint32))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["shard", "bits"])

    rows = vocabulary.select("word").mapInArrow(hashed, "shard bigint, block bigint, h bigint, size bigint")
    return rows.groupBy("shard").applyInArrow(build, "shard bigint, bits binary")


class Probe:
    """Broadcast filters of one pass: rows of eight lanes, and where each shard begins (-1: in another pass)."""

    def __init__(self, shards: Shards, filters: dict[int, bytes]):
        self.shards, self.start = shards, np.full(len(shards.bytes), -1, np.int64)
        held, rows = [], 0
        for shard, bits in filters.items():
            self.start[shard] = rows
            held.append(np.frombuffer(bits, np.uint32).reshape(-1, _LANES))
            rows += len(held[-1])
        self.rows = np.concatenate(held)

    def hits(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` of the words that may be in the vocabulary."""
        shard = self.shards.of(length, h)
        if shard is None:
            return np.zeros(0, np.int64)
        left = np.flatnonzero(self.start[shard] >= 0)
        h = h[left]
        row = self.start[shard[left]] + self.shards.block(length, h)
        for lane in range(_LANES):
            stay = np.flatnonzero(self.rows[row, lane] & _lane_bits(h, lane).astype(np.uint32))
            left, h, row = left[stay], h[stay], row[stay]
        return left


def _edits(points: np.ndarray, probe: Probe) -> Iterator[tuple[int, int, int]]:
    """(row, place, code point put there or -1 for a deletion) of edits that the filters know, each different edit once."""
    n, size = points.shape
    powers, alphabet = _powers(size), ALPHABET.astype(np.uint64)
    before = np.concatenate((np.zeros((n, 1), np.uint64), np.cumsum(points * powers[:-1], axis=1, dtype=np.uint64)), axis=1)
    total, step = before[:, -1:], max(1, EDITS // max(1, n * len(alphabet)))
    for begin in range(0, size, step):
        here = points[:, begin : begin + step]
        end = begin + here.shape[1]
        rest = (total - before[:, begin + 1 : end + 1]) * np.uint64(_INVERSE)
        new = np.ones(here.shape, bool)
        new[:, 1:] = here[:, 1:] != here[:, :-1]
        if begin:
            new[:, 0] = here[:, 0] != points[:, begin - 1]
        at = np.flatnonzero(new)
        for k in at[probe.hits(size - 1, _mixed((before[:, begin:end] + rest).ravel()[at], size - 1))].tolist():
            yield k // here.shape[1], begin + k % here.shape[1], -1
        later = np.flatnonzero(alphabet > here[:, :, None])
        sums = (total[:, :, None] + (alphabet - here[:, :, None]) * powers[begin:end, None]).ravel()[later]
        for k in later[probe.hits(size, _mixed(sums, size))].tolist():
            place, letter = divmod(k, len(alphabet))
            yield place // here.shape[1], begin + place % here.shape[1], int(ALPHABET[letter])


def _candidates(vocabulary: DataFrame, probe: Probe) -> DataFrame:
    """(word, n, other): edits of words that the pass's filters know."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(probe)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for size, at in _by_length(words):
                step = max(1, EDITS // (size * len(ALPHABET)))
                for begin in range(0, len(at), step):
                    some, out = at[begin : begin + step], []
                    for row, place, letter in _edits(_points([words[i] for i in some]), shared.value):
                        word = words[some[row]]
                        out.append((word, counts[some[row]], word[:place] + (chr(letter) if letter >= 0 else "") + word[place + 1 :]))
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["word", "n", "other"])

    return vocabulary.select("word", "n").mapInArrow(ask, "word string, n bigint, other string")


def near_pairs(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, filter_bytes: int = FILTER_BYTES) -> DataFrame | None:
    """(word, n, other, other_n): each pair of words of the stored table (word, n) that differ by one code point, once; None without words."""
    sizes = vocabulary.groupBy(F.least(F.char_length("word"), F.lit(LONGEST)).alias("size")).count()
    shards = Shards({r["size"]: r["count"] for r in sizes.collect()}, shard_words)  # at most LONGEST rows
    filters = stored(_filters(vocabulary, shards))
    found = None
    for group in shards.passes(filter_bytes):
        held = {r["shard"]: bytes(r["bits"]) for r in filters.filter(F.col("shard").between(group[0], group[-1])).toLocalIterator()}  # at most filter_bytes
        some = _candidates(vocabulary, Probe(shards, held))
        found = some if found is None else found.union(some)
    if found is None:
        return None
    return found.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def follow(forms: DataFrame, most_rounds: int = 8) -> DataFrame:
    """(word, root) of every row (word, form): the last word that forms lead to. Each round doubles the length of the path."""
    roots = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        later = roots.select(F.col("word").alias("root"), F.col("root").alias("later"))
        roots = stored(roots.join(later, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")))
        if roots.filter("moved").isEmpty():
            return roots.drop("moved")
        roots = roots.drop("moved")
    raise RuntimeError(f"forms were not followed to their end in {most_rounds} rounds")


def variant_groups(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), each word once."""
    vocabulary = stored(words.select("word", "n"))
    pairs = near_pairs(vocabulary, shard_words, filter_bytes)
    if pairs is None:
        return vocabulary.select("word", F.col("word").alias("form"), F.col("word").alias("root"), "n", F.col("n").alias("n_near"), F.col("n").alias("form_n"))
    both = F.explode(F.array(F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    best = F.min(F.struct((-F.col("other_n")).alias("fewer"), "other")).alias("best")
    near = pairs.select(both.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = vocabulary.join(near, "word", "left")
    leads = -F.col("best.fewer") >= F.lit(ratio) * F.col("n")
    judged = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.fewer")).alias("form_n")))
    roots = follow(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
