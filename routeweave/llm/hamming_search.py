"""Operator 5: exact top-k search of binary codes by incremental multi-index hashing.

Codes are dealt over *shards* of bounded size, and queries, in blocks, meet every shard. A shard keeps one table for
each of m segments of a code, of about log2(codes of a shard) bits each. For radius 0, 1, 2, ... each query looks up all
values at exactly that distance from its own in one segment after the other; the codes found are verified by their whole
Hamming distance and the best k kept. With the first a segments searched to radius r and the others to r - 1, a code that
was not found differs by at least m * r + a bits, so a query stops as soon as its k-th verified distance is below that.
The answer is exact, ties going to the smaller id.

There are two rounds. The first grows radii up to ``FIRST_RADIUS`` in every shard; merged, its results bound each query's
k-th distance over all shards, which most unresolved queries need to stop early in the second round. Shards emit at most
k rows for a query, so what is merged does not depend on how many codes lie near.

Rows with one code are one index entry with its ``k + 1`` smallest ids (no other id of that code can be among the k
best), so a very common vector is one entry and ranking it is a map-side combined aggregate.

Defined cases: rows without an embedding or id are neither queries nor answers; the width is that of the longest
embedding, whatever it is (an array of 64-bit words), and a shorter one has zero bits at the end; null and NaN
components are zero bits and one bits; repeated ids count once, by the smallest code; a query is not its own answer; with
fewer than k other rows all of them are returned; an empty table yields no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

K = 10
#: Bits of one word of a code.
WORD_BITS = 64
#: Codes of a shard: no more than the first, and no more shards than one for so many codes as the second; queries of a block.
SHARD_CODES, LEAST_CODES, QUERY_BLOCK = 1 << 22, 1 << 12, 1 << 20
#: Radius to which the first round searches.
FIRST_RADIUS = 2
#: Probes looked up, and queries answered, together.
_PROBES, _QUERIES = 1 << 18, 1024


def embedding_bits(vectors: DataFrame) -> int:
    """Dimensions of the longest embedding: the width of a code that leaves none out."""
    return max(1, vectors.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 1)


def sign_code(embedding: Column, bits: int) -> Column:
    """array<bigint>: one bit for each dimension, is it above zero. The first is the highest of its word."""
    padded = F.concat(embedding, F.array_repeat(F.lit(0.0).cast("float"), bits))

    def word(first: int, n: int) -> Column:
        one = lambda x: F.when(F.coalesce(x, F.lit(0.0)) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        return F.aggregate(F.slice(padded, first + 1, n), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(one(x)))

    return F.array(*[word(first, n) for first, n in _spans(bits)])


def _spans(bits: int) -> list[tuple[int, int]]:
    """(first dimension, bits) of each word of a code."""
    return [(first, min(WORD_BITS, bits - first)) for first in range(0, bits, WORD_BITS)]


def segments(bits: int, codes: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of each segment, about log2(codes) bits wide."""
    found = []
    for word, (_, n) in enumerate(_spans(bits)):
        m = max(1, min(n, round(n / max(4, min(22, math.log2(max(codes, 2)))))))
        edges = [n * k // m for k in range(m + 1)]
        found += [(word, a, b - a) for a, b in zip(edges, edges[1:])]
    return found


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``n`` places, one range after another."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Shard:
    """Codes (rows of words) by the value of each segment."""

    def __init__(self, codes: np.ndarray, parts: list[tuple[int, int, int]]):
        self.codes, self.parts, self.order, self.start = codes, parts, [], []
        for part in parts:
            values = self._own(codes, part)
            self.order.append(np.argsort(values, kind="stable"))
            self.start.append(np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << part[2])))))

    @staticmethod
    def _own(codes: np.ndarray, part: tuple[int, int, int]) -> np.ndarray:
        word, shift, width = part
        return ((codes[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def probe(self, queries: np.ndarray, segment: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, place of the code) of the codes whose segment is a query's own, changed by one of the masks."""
        values = (self._own(queries, self.parts[segment])[:, None] ^ masks).ravel()
        begin, end = self.start[segment][values], self.start[segment][values + 1]
        full = np.flatnonzero(end > begin)
        n = end[full] - begin[full]
        return np.repeat(full // len(masks), n), self.order[segment][_ranges(begin[full], n)]

    def search(self, queries: np.ndarray, least: np.ndarray, k: int, radii: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, place of the code, distance) of codes found at the radii. ``least``: for each query, the k
        smallest distances known so far (large where there are fewer); a query stops when they are covered."""
        least, found = least.copy(), []
        m = len(self.parts)
        for radius in radii:
            for segment, (_, _, width) in enumerate(self.parts):
                waiting = np.flatnonzero(least[:, -1] >= m * radius + segment)
                if not len(waiting):
                    return self._all(found)
                if radius > width:
                    continue
                masks = np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)
                for some in np.array_split(waiting, min(len(waiting), math.ceil(len(waiting) * len(masks) / _PROBES))):
                    q, c = self.probe(queries[some], segment, masks)
                    q = some[q]
                    distance = np.bitwise_count(queries[q] ^ self.codes[c]).sum(axis=1, dtype=np.int64)
                    near = distance <= least[q, -1]
                    found.append((q[near], c[near], distance[near]))
            least = self._tightened(least, self._all(found), k)
        return self._all(found)

    def _all(self, found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A code may be found by several segments; once is enough."""
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        q, c, d = (np.concatenate(x) for x in zip(*found))
        _, first = np.unique(q * len(self.codes) + c, return_index=True)
        return q[first], c[first], d[first]

    @staticmethod
    def _tightened(least: np.ndarray, found: tuple[np.ndarray, ...], k: int) -> np.ndarray:
        """``least`` with the k smallest distances of different codes found here, where those are better: one id at least
        stands behind each, but one of them may be the query's own."""
        q, _, d = found
        order = np.lexsort((d, q))
        q, d = q[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kth = place == k  # the (k + 1)-th code: k of them have another id
        out = least.copy()
        out[q[kth], -1] = np.minimum(out[q[kth], -1], d[kth])
        return out


def _search(index: DataFrame, queries: DataFrame, shards: int, blocks: int, parts: list[tuple[int, int, int]], bits: int, k: int, radii: range) -> DataFrame:
    """(query_id, neighbor_id, distance): each shard's at most k best. ``index``: (shard, code, ids); ``queries``: (id, code, least)."""
    words = len(_spans(bits))

    def rows_of(rows: pa.Table, column: str, width: int) -> np.ndarray:
        return pc.list_flatten(rows[column]).to_numpy().astype(np.int64, copy=False).reshape(-1, width)

    def answers(shard: Shard, ids: np.ndarray, size: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        own = rows["id"].to_numpy()
        q, c, d = shard.search(rows_of(rows, "code", words).view(np.uint64), rows_of(rows, "least", k), k, radii)
        n, start = size[c], np.cumsum(size) - size
        q, neighbor, d = np.repeat(q, n), ids[_ranges(start[c], n)], np.repeat(d, n)
        other = neighbor != own[q]
        q, neighbor, d = q[other], neighbor[other], d[other]
        order = np.lexsort((neighbor, d, q))
        q, neighbor, d = q[order], neighbor[order], d[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pa.RecordBatch.from_arrays([pa.array(own[q[best]]), pa.array(neighbor[best]), pa.array(d[best])], names=["query_id", "neighbor_id", "distance"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, its codes before its queries."""
        part, codes, ids, sizes, shard = None, [], [], [], None
        for batch in batches:
            places, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((places[1:] != places[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if begin == end:
                    continue
                rows = pa.Table.from_batches([batch.slice(begin, end - begin)])
                if places[begin] != part:
                    part, codes, ids, sizes, shard = places[begin], [np.zeros((0, words), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], None
                if not kinds[begin]:
                    codes.append(rows_of(rows, "code", words).view(np.uint64))
                    ids.append(pc.list_flatten(rows["ids"]).to_numpy())
                    sizes.append(pc.list_value_length(rows["ids"]).to_numpy().astype(np.int64))
                    continue
                if shard is None:
                    shard, ids, sizes = Shard(np.concatenate(codes), parts), [np.concatenate(ids)], [np.concatenate(sizes)]
                for some in range(0, rows.num_rows, _QUERIES):
                    yield answers(shard, ids[0], sizes[0], rows.slice(some, _QUERIES))

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), F.lit(True).alias("asks"), "id", "code", F.lit(None).cast("array<bigint>").alias("ids"), "least")
    held = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), F.lit(None).cast("bigint").alias("id"), "code", "ids", F.lit(None).cast("array<bigint>").alias("least"))
    part = (F.col("shard").cast("bigint") * blocks + F.col("block")).alias("part")
    rows = held.union(asked).select(part, "asks", "id", "code", "ids", "least").repartition("part").sortWithinPartitions("part", "asks")
    return rows.mapInArrow(search, "query_id bigint, neighbor_id bigint, distance bigint")


def top_k(codes: DataFrame, queries: DataFrame, k: int, bits: int, shard_codes: int = SHARD_CODES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) for each row of ``queries`` (id, code) over all rows of ``codes`` (id, code)."""
    spark = codes.sparkSession
    # the k + 1 smallest ids of a code, by a map-side combined aggregate: ids of one code are first thinned by a hash of the id
    place = F.row_number().over(Window.partitionBy("code", "thin").orderBy("id"))
    thin = codes.withColumn("thin", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = thin.withColumn("place", place).filter(F.col("place") <= k + 1)
    ids = F.slice(F.sort_array(F.collect_list("id")), 1, k + 1)
    index = stored(few.groupBy("code").agg(ids.alias("ids")))
    n = index.count()
    shards = max(1, math.ceil(n / shard_codes), min(shuffle_partitions(spark), math.ceil(n / LEAST_CODES)))
    parts = segments(bits, math.ceil(n / shards))
    index = index.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int"))
    none = F.array_repeat(F.lit(bits + 1).cast("bigint"), k)
    queries = stored(queries.select("id", "code"))
    blocks = max(1, math.ceil(queries.count() / query_block))
    own = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    first = _search(index, queries.withColumn("least", none), shards, blocks, parts, bits, k, range(FIRST_RADIUS + 1))
    first = stored(first.withColumn("rank", F.row_number().over(own).cast("bigint")).filter(F.col("rank") <= k))
    known = first.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list("distance")).alias("found"))
    left = queries.join(known, "id", "left").withColumn("least", F.slice(F.concat(F.coalesce("found", F.array().cast("array<bigint>")), none), 1, k))
    left = stored(left.filter(F.get("least", k - 1) >= len(parts) * (FIRST_RADIUS + 1)).select("id", "code", "least"))
    more = _search(index, left, shards, blocks, parts, bits, k, range(FIRST_RADIUS + 1, max(width for _, _, width in parts) + 1))
    every = first.select("query_id", "neighbor_id", "distance").union(more).distinct()
    return every.withColumn("rank", F.row_number().over(own).cast("bigint")).filter(F.col("rank") <= k)


def search_embeddings(vectors: DataFrame, every: int = 20, k: int = K, bits: int | None = None) -> DataFrame:
    """Top k of the sign codes of ``vectors`` (vec_id, embedding) for each row whose id is divisible by ``every``, over all rows.

    ``bits`` of ``None``: as many as the longest embedding has dimensions.
    """
    known = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    bits = bits or embedding_bits(known)
    rows = known.select(F.col("vec_id").cast("bigint").alias("id"), sign_code(F.col("embedding"), bits).alias("code"))
    top = F.lit(-(1 << 63)).cast("bigint")  # changes the order of signed words into that of their bits
    codes = stored(rows.groupBy("id").agg(F.min_by("code", F.transform("code", lambda w: w.bitwiseXOR(top))).alias("code")))
    return top_k(codes, codes.filter(F.col("id") % every == 0), k, bits)
