"""Operator 4: substring dedup by fixed-block anchors.

Every window of ``window`` words holds a whole block of ``(window + 1) // 2`` words that starts at a multiple of that
length, wherever it lies. So these non-overlapping blocks are indexed, every rolling window of block length probes the
index, and each repeated window holds a hit in all its places. Around the hits the full windows are hashed and counted;
windows that occur again extend the hits to maximal exact repeats, as overlapping windows join into spans.

Scale: a Bloom filter over the index drops most probes before the shuffle. It has at least ``BITS_A_BLOCK`` bits for each
block (about 3 % pass falsely) as long as ``MOST_PASSES`` passes over the texts, each with the blocks of one hash range
and at most ``MOST_BITS`` bits, hold them: some 500 million blocks. Beyond that it drops fewer and the result is the
same. Hits need no exact join: a bitmap of the block hashes that occur again keeps their places, and a place kept falsely
only adds windows that are then found not to repeat. Occurrences of a common passage are counted with map-side combine
and never paired, and the join of windows with the repeated ones has its two sides straight from their shuffles, so that
adaptive execution can split a hot window. Whole copies are settled by the hash of their word sequence, and only one of
each class is compared with other texts. Texts without hits are not shuffled, nor are those without spans at the end.

Defined cases: a null text has no words; a very long text is hashed whole, at some 60 bytes of memory a word; rows are
documents of their own, so a repeated row repeats all its windows; a null doc_id is a value like others; an empty table
yields no rows; extra columns are carried through, those named like a result are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .filters import DOC_BITS, bloom_filter, hash_filter, in_bloom, in_filter, rows_in_filter
from .shingles import _finish, hashed_texts, runs

WINDOW = 35
#: Least bits of the filter for each indexed block, the most in one pass over the texts, and the most passes (a power of two).
BITS_A_BLOCK, MOST_BITS, MOST_PASSES = 8, 1 << 30, 4
#: Bits of the filter for each block that occurs again.
BITS_A_HIT = 64
KEY = ["id", "k"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by their doc_id and a hash of the row, so that repeated ids do no harm."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("doc_id", "text").alias("k"), F.col("text").cast("string"))


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def index_blocks(keyed: DataFrame, block: int) -> DataFrame:
    """(id, k, n_words, sequence, blocks): the hash of a document's whole word sequence, and of its blocks at multiples of ``block``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part, hashes, counts in hashed_texts(batches, 2, lower=False):
                every, end = runs(hashes, block), 0
                for i, k, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), counts.tolist()):
                    start, end = end, end + n
                    blocks = every[start : max(start, end - block + 1) : block]
                    yield i, k, n, xxhash.xxh3_128_digest(hashes[start:end].tobytes()), blocks.view(np.int64)

        return _batches(rows(), [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())], ["id", "k", "n_words", "sequence", "blocks"])

    return keyed.mapInArrow(index, "id bigint, k bigint, n_words bigint, sequence binary, blocks array<bigint>")


def probes(keyed: DataFrame, block: int, bitmap: np.ndarray, turn: int = 0, passes: int = 1) -> DataFrame:
    """(h, id, k, pos) of every rolling window of block length, other than the indexed ones, that may be in the index; only those of the hash range ``turn`` of ``passes``."""
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for part, hashes, counts in hashed_texts(batches, 2, lower=False):
            h = runs(hashes, block)
            if passes == 1:
                at = in_bloom(bits, h)
            else:
                own = np.flatnonzero(hash_range(h, passes) == turn)
                at = own[in_bloom(bits, h[own])]
            ends = np.cumsum(counts)
            doc = np.searchsorted(ends, at, side="right")
            pos = at - (ends - counts)[doc]
            keep = (pos + block <= counts[doc]) & (pos % block > 0)
            at, doc, pos = at[keep], doc[keep], pos[keep]
            if len(at):
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), part.column(0).take(rows), part.column(1).take(rows), pa.array(pos.astype(np.int32))], names=["h", *KEY, "pos"])

    return keyed.mapInArrow(probe, "h bigint, id bigint, k bigint, pos int")


def hash_range(h: np.ndarray, passes: int) -> np.ndarray:
    """Which of ``passes`` (1, 2 or 4) ranges a hash is in, by its highest bits."""
    return (h >> np.uint64(62)) & np.uint64(passes - 1)


def index_probes(indexed: DataFrame, keyed: DataFrame, block: int, most_bits: int = MOST_BITS) -> DataFrame:
    """The probes of all hash ranges, written."""
    n_blocks = indexed.agg(F.coalesce(F.sum(F.size("blocks")), F.lit(0))).first()[0]
    need = max(n_blocks, 1) * BITS_A_BLOCK
    passes = next((p for p in (1, 2, 4) if p * most_bits >= need), MOST_PASSES)
    bits = min(most_bits, 1 << max(20, math.ceil(math.log2(need / passes))))
    blocks, found = indexed.select(F.explode("blocks").alias("h")), None
    for turn in range(passes):
        own = blocks.filter(F.shiftrightunsigned("h", 62).bitwiseAND(F.lit(passes - 1).cast("bigint")) == turn) if passes > 1 else blocks
        some = stored(probes(keyed, block, bloom_filter(own, bits), turn, passes))
        found = some if found is None else found.union(some)
    return found


def anchors(indexed: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """(id, k, at): the places in each document whose block occurs again, one of them in the index; and, falsely, few others."""
    own = indexed.select(F.posexplode("blocks").alias("n", "h"), *KEY).select("h", *KEY, (F.col("n") * block).alias("pos"), F.lit(1).alias("indexed"))
    every = own.union(found.select("h", *KEY, "pos", F.lit(0)))
    again = stored(every.groupBy("h").agg(F.count("*").alias("n"), F.max("indexed").alias("indexed")).filter("n > 1 AND indexed = 1").select("h"))
    bits = min(MOST_BITS, 1 << max(20, math.ceil(math.log2(max(again.count(), 1) * BITS_A_HIT))))
    hits = rows_in_filter(every.select("h", *KEY, "pos"), "h", hash_filter(again, bits))
    return hits.groupBy(*KEY).agg(F.collect_set("pos").alias("at"))


def windows_near(texts: DataFrame, window: int, block: int) -> DataFrame:
    """(h1, h2, id, k, start) of every window that holds an anchor. ``texts``: (id, k, text, at)."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashes, counts in hashed_texts(batches, 2, lower=False):
            first, second, end = runs(hashes, window), runs(_finish(hashes + np.uint64(1)), window), 0
            found = []
            for k, (n, at) in enumerate(zip(counts.tolist(), part.column(3))):
                begin, end = end, end + n
                if n >= window:
                    marks, pos = np.zeros(n + 1, np.int32), at.values.to_numpy()
                    np.add.at(marks, np.maximum(pos - (window - block), 0), 1)
                    np.add.at(marks, pos + 1, -1)
                    start = np.flatnonzero(np.cumsum(marks)[: n - window + 1])
                    found.append((np.full(len(start), k), begin + start, start))
            if found:
                row, at, start = (np.concatenate(x) for x in zip(*found))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[at].view(np.int64)), pa.array(second[at].view(np.int64)), part.column(0).take(row), part.column(1).take(row), pa.array(start.astype(np.int32))],
                    names=["h1", "h2", *KEY, "start"],
                )

    return texts.select(*KEY, "text", "at").mapInArrow(near, "h1 bigint, h2 bigint, id bigint, k bigint, start int")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, k, spans) of the documents that have repeats: the spans [start, end) of words, in order and apart, that repeated windows cover."""
    block, keyed = (window + 1) // 2, _keyed(docs)
    indexed = stored(index_blocks(keyed, block))
    classes = indexed.filter(F.col("n_words") >= window).groupBy("sequence").agg(F.count("*").alias("copies"), F.min(F.struct(*KEY)).alias("first")).filter("copies > 1")
    copies = stored(indexed.filter(F.col("n_words") >= window).join(classes, "sequence").select(*KEY, "n_words", (F.struct(*KEY) == F.col("first")).alias("is_first")).distinct())
    others = copies.filter("NOT is_first").select(*KEY)
    single = indexed.join(others, KEY, "left_anti").dropDuplicates(KEY)
    found = index_probes(indexed, keyed, block).join(others, KEY, "left_anti")
    hits = stored(anchors(single.select(*KEY, "blocks"), found, block))
    texts = rows_in_filter(keyed, "k", hash_filter(hits.select("k"), DOC_BITS)).join(hits, KEY).dropDuplicates(KEY)
    near = stored(windows_near(texts, window, block))
    again = stored(near.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"))
    starts = near.join(again, ["h1", "h2"], "left_semi").groupBy(*KEY).agg(F.sort_array(F.collect_list("start")).alias("starts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans() -> Iterator[tuple]:
            for batch in batches:
                for i, k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    s = s.values.to_numpy()
                    first = np.concatenate(([True], s[1:] > s[:-1] + window))
                    last = np.concatenate((first[1:], [True]))
                    yield i, k, [{"start": a, "end": b + window} for a, b in zip(s[first].tolist(), s[last].tolist())]

        return _batches(spans(), [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))], [*KEY, "spans"])

    schema = "id bigint, k bigint, spans array<struct<start:int,end:int>>"
    partial = starts.join(copies.select(*KEY), KEY, "left_anti").mapInArrow(joined, schema)
    whole = copies.select(*KEY, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).alias("spans"))
    return partial.union(whole)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with its words that are left, joined by one space, in ``text``, and n_words, n_removed: words of windows that start elsewhere as well are removed, in all their places."""
    spans = stored(repeated_spans(docs, window))
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    keys = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("doc_id", "text").alias("k")]
    rows = docs.select(F.col("text").cast("string"), F.struct(*rest).alias("rest"), *keys)
    with_spans = hash_filter(spans.select("k"), DOC_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(with_spans)

    def cut(texts: list[str | None], spans: list[list[dict] | None], rest: pa.Array) -> pa.RecordBatch:
        kept, n_words, n_removed = [], [], []
        for text, gone in zip(texts, spans):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n_words.append(len(words))
            for s in reversed(gone or ()):
                del words[s["start"] : s["end"]]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_arrays([rest, pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["rest", "text", "n_words", "n_removed"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(2).to_numpy().view(np.uint64)
            batch = batch.filter(pa.array(~in_filter(shared.value, k)))
            yield cut(batch.column(0).to_pylist(), [None] * batch.num_rows, batch.column(1))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cut(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))

    schema = f"rest {rows.schema['rest'].dataType.simpleString()}, text string, n_words bigint, n_removed bigint"
    untouched = rows.select("text", "rest", "k").mapInArrow(whole, schema)
    touched = rows_in_filter(rows, "k", with_spans).join(spans, KEY, "left").select("text", "spans", "rest").mapInArrow(parted, schema)
    return untouched.union(touched).select("rest.*", "text", "n_words", "n_removed")
