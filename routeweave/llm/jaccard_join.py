"""Operator 7: n-gram Jaccard join by a grouped prefix join.

1. One pass over the texts counts shingles within bounded chunks and sums those that repeat in a chunk; the
   most frequent ones are sorted behind all others. Any common order gives the same links; this one keeps common
   passages out of the prefixes.
2. A second pass gives each document its prefix (under that order, as many shingles as a partner must touch), a
   parity bitmap of its set, and hashes of the set and of (size, prefix). Documents with equal sets are one
   *class*; classes with the same size and prefix are one *group*.
3. Groups that share a prefix shingle meet in that shingle's buckets, one for each band of sizes, a group standing in its
   own band and the next: a group without another of a fitting size is left out before its members are expanded, and a
   hot shingle is split by size. The members of one group meet in the group's own bucket. Buckets are dealt in blocks of
   bounded size. There, pairs of groups are filtered by size and only the members of those that pass are paired and
   compared by bitmap, pairs that pass by a finer one that grows with the set: the bits in which two differ never outnumber
   the shingles in which the sets differ, so no link is lost. Of a spanning forest of each bucket, one pair of each document is verified on the
   full sets.
4. Components of the verified links are formed. A pair that could join two of them is spanned by a path of forest pairs
   on which each component is left by a pair that is no link, so only components at such ends are searched again; every pair between two of them is verified,
   and the components are final. Links inside a component change no result and are not listed.

Defined cases: a null text or one without words is linked with nothing; a very long text is hashed whole, at some 60
bytes of memory a word, and its whole set is compared; equal rows have equal sets and are linked; rows that repeat a
doc_id are one document with the greatest of their texts, and all have its component; there are no ties, as nothing is
ranked; an empty table yields no rows; a null doc_id forms no link of its own; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .filters import DOC_BITS, bloom_filter, hash_filter, in_bloom, rows_in_filter
from .graph import connected_components
from .shingles import hashed_texts, shingle_sets

WIDTH, PERCENT = 3, 90
#: Shingles counted together; how often one must repeat there; how many of the most frequent ones are sorted last.
CHUNK, REPEATS, HEAVY = 4_000_000, 4, 1 << 18
#: Bits of a set's coarse bitmap; least and most bits of its fine one, which otherwise has as many as shingles, so that long sets do not fill it.
BITS, FINE_BITS, MOST_FINE_BITS = 512, 2048, 1 << 16
#: Least bits of the filter for each shared shingle, and the most there are.
BITS_A_SHINGLE, MOST_BITS = 8, 1 << 28
#: Most members of a block of a bucket.
BLOCK = 2048
#: Most texts that meet one other text in a part.
PARTNERS = 64
#: Pairs of members compared together.
PAIRS = 1 << 20


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    for rows, hashes, counts in hashed_texts(batches, 1, lower=True):
        yield from zip(rows.column(0).to_pylist(), shingle_sets(hashes, counts, width))


def frequent_shingles(docs: DataFrame, width: int, heavy: int = HEAVY) -> np.ndarray:
    """At most ``heavy`` shingles, rarest first: those that occur ``REPEATS`` times in some chunk, by their summed counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sums() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= REPEATS
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["shingle", "n"])

        for _, s in _sets(batches, width):
            held.append(s)
            size += len(s)
            if size >= CHUNK:
                yield sums()
                held, size = [], 0
        if size:
            yield sums()

    counts = docs.select("doc_id", "text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "shingle").limit(heavy).toPandas()
    return rows["shingle"].to_numpy(dtype=np.int64)[::-1].view(np.uint64).copy()


def fine_bits(n: int) -> int:
    """Bits of the fine bitmap of a set of ``n`` shingles, a power of two."""
    return min(MOST_FINE_BITS, max(FINE_BITS, 1 << (n - 1).bit_length()))


def differing(x: bytes, y: bytes) -> int:
    """In how many bits two parity bitmaps differ; the longer one is folded to the length of the other."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)))).sum())


def signatures(docs: DataFrame, width: int, percent: int, last: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, set_id, group_id, bitmap, fine, prefix) of each document; the last five are null for an empty set."""
    by_value = np.argsort(last)
    known, rank = last[by_value], by_value

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc_id, s in _sets(batches, width):
            n = len(s)
            if n:
                need = n - (percent * n + 99) // 100 + 1
                at = np.searchsorted(known, s) if len(known) else np.zeros(n, np.int64)
                common = known[np.minimum(at, len(known) - 1)] == s if len(known) else np.zeros(n, bool)
                prefix = s[~common][:need]
                if len(prefix) < need:
                    late = np.flatnonzero(common)
                    prefix = np.concatenate([prefix, s[late[np.argsort(rank[at[late]])][: need - len(prefix)]]])
                size = fine_bits(n)
                fine = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
                bits = np.bitwise_xor.reduce(fine.reshape(-1, BITS)).astype(np.uint8)
                group = xxhash.xxh3_128_digest(np.sort(prefix).tobytes() + n.to_bytes(8, "little"))
                rows.append((doc_id, n, xxhash.xxh3_128_digest(s.tobytes()), group, np.packbits(bits).tobytes(), np.packbits(fine.astype(np.uint8)).tobytes(), prefix.view(np.int64)))
            else:
                rows.append((doc_id, 0, None, None, None, None, None))
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_shingles", "set_id", "group_id", "bitmap", "fine", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, n_shingles bigint, set_id binary, group_id binary, bitmap binary, fine binary, prefix array<bigint>")


def size_band(n: Column, percent: int) -> Column:
    """Sets whose sizes allow a similarity of ``percent`` % are in the same band or in neighbouring ones."""
    if percent == 100:
        return 2 * n  # only equal sizes meet
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9)


def shared_tokens(filled: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(shingle, gid, band) of the prefix shingles of documents that are in ``shared`` (shingle), and of few others, which then find no
    partner: a Bloom filter in the scan keeps all other shingles out of every shuffle."""
    bits = min(MOST_BITS, 1 << max(20, math.ceil(math.log2(max(shared.count(), 1) * BITS_A_SHINGLE))))
    bitmap = filled.sparkSession.sparkContext.broadcast(bloom_filter(shared, bits))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            shingles, owner = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            at = in_bloom(bitmap.value, shingles.view(np.uint64))
            rows = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([pa.array(shingles[at]), *[batch.column(k).take(rows) for k in (1, 2)]], names=["shingle", "gid", "band"])

    rows = filled.select("prefix", F.col("doc_id").alias("gid"), size_band(F.col("n_shingles"), percent).cast("bigint").alias("band"))
    return rows.mapInArrow(keep, "shingle bigint, gid bigint, band bigint")


def buckets(classes: DataFrame, filled: DataFrame, percent: int) -> DataFrame:
    """(bucket, own, here, gid, size, rep): the members of each group of several, and of all groups that share a prefix shingle and
    have one of a fitting band of sizes beside them. here: in the group's own band; size: of the bucket."""
    # copies are counted as well: their shingles pass here and are left behind by the join with the groups' leaders
    shared = stored(filled.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select("shingle"))
    leading = classes.filter("rep = gid").select("gid", F.col("members").cast("int").alias("members"))
    bands = F.explode(F.array(F.struct(F.lit(0).alias("up"), F.lit(True).alias("here")), F.struct(F.lit(1).alias("up"), F.lit(False).alias("here")))).alias("x")
    tokens = shared_tokens(filled, shared, percent).join(leading, "gid").select("shingle", "gid", "members", "band", bands)
    met = stored(tokens.select(F.xxhash64("shingle", F.col("band") + F.col("x.up")).alias("bucket"), "gid", "members", "x.here"))
    fitting = met.groupBy("bucket").agg(F.count("*").alias("groups"), F.max("here").alias("any"), F.sum("members").alias("size")).filter("groups > 1 AND any").select("bucket", "size")
    by_token = met.join(fitting, "bucket").select("bucket", F.lit(False).alias("own"), "here", "gid", "size")
    own = classes.filter("rep = gid AND members > 1").select(F.col("gid").alias("bucket"), F.lit(True), F.lit(True), "gid", F.col("members"))
    return by_token.union(own).join(classes.select("gid", "rep"), "gid")


def _dealt(members: DataFrame) -> DataFrame:
    """Adds ``part``: a bucket of more than ``BLOCK`` members is cut in blocks by hash, and every two of its blocks meet in one part."""
    rows = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.xxhash64("bucket", "own", F.least("block", "other"), F.greatest("block", "other"))
    return rows.withColumn("part", part).drop("blocks", "block", "other", "bucket", "size")


def candidate_pairs(members: DataFrame, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b) of members of one bucket that size and bitmap allow; ``sets``: (rep, n, bitmap). ``forest``: a spanning forest of each part only; else the pairs of different ``component``."""

    def find(parent: list[int], x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def steps(part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of places with equal ``part`` (sorted), those at distance 1, 2, ... at once."""
        active, step = np.arange(len(part)), 1
        while True:
            active = active[active + step < len(part)]
            active = active[part[active] == part[active + step]]
            if not len(active):
                return
            yield active, active + step
            step += 1

    def member_pairs(rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members in one group's own bucket, and of members of two groups of a bucket that their sizes and bands allow."""
        part, group, own, here, n = (rows[c] for c in ("part", "gid", "own", "here", "n"))
        inside = np.flatnonzero(own)
        for i, j in steps(part[inside]):
            yield inside[i], inside[j]
        start = np.flatnonzero(~own & np.concatenate(([True], (part[1:] != part[:-1]) | (group[1:] != group[:-1]) | own[:-1])))
        if not len(start):
            return
        outside = np.flatnonzero(~own)
        size = np.diff(np.append(np.searchsorted(outside, start), len(outside)))
        for p, q in steps(part[start]):
            a, b = start[p], start[q]
            ok = (100 * n[a] >= percent * n[b]) & (100 * n[b] >= percent * n[a]) & (here[a] | here[b])
            p, q = p[ok], q[ok]
            count = size[p] * size[q]
            cuts = np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1 if len(p) else []
            for p, q, count in zip(np.split(p, cuts), np.split(q, cuts), np.split(count, cuts)):
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                width = np.repeat(size[q], count)
                yield np.repeat(start[p], count) + at // width, np.repeat(start[q], count) + at % width

    def pairs_of(rows: dict[str, np.ndarray], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right, n, rep, component = [], [], rows["n"], rows["rep"], rows.get("component")
        for i, j in member_pairs(rows):
            if component is not None:
                ok = component[i] != component[j]
                i, j = i[ok], j[ok]
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            ok = differ * (100 + percent) <= (100 - percent) * (n[i] + n[j])
            left.append(i[ok])
            right.append(j[ok])
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        if component is None:  # in one order everywhere, so that buckets with the same members choose the same pairs
            order = np.lexsort((np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j])))
            i, j = i[order], j[order]
            parent = list(range(len(rep)))
            keep = []
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                x, y = find(parent, x), find(parent, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    keep.append(k)
            i, j = i[keep], j[keep]
        return rep[i], rep[j]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        told: set[tuple[int, int]] = set()

        def run(rows: pa.Table) -> pa.RecordBatch:
            bits = np.frombuffer(b"".join(rows["bitmap"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
            a, b = pairs_of({c: rows[c].to_numpy(zero_copy_only=False) if isinstance(rows[c], pa.Array) else rows[c].to_numpy() for c in names}, bits)
            pairs = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) - told
            if len(told) < 500_000:
                told.update(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:  # sorted by part; the last part of a batch may go on in the next
            if not batch.num_rows:
                continue
            held.append(batch)
            parts = batch.column(0).to_numpy()
            if parts[0] != parts[-1]:
                rows = pa.Table.from_batches(held)
                cut = rows.num_rows - int((parts[::-1] == parts[-1]).argmin())
                yield run(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield run(pa.Table.from_batches(held))

    names = ["part", "gid", "own", "here", "rep", "n", *([] if forest else ["component"])]
    rows = _dealt(members).join(sets, "rep").select(*names, "bitmap").repartition("part").sortWithinPartitions("part", "gid", "rep")
    return rows.mapInArrow(search, "a bigint, b bigint").distinct()


def finer(pairs: DataFrame, filled: DataFrame, percent: int) -> DataFrame:
    """The pairs that the fine bitmaps allow as well."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = rows_in_filter(filled.select("doc_id", "n_shingles", "fine"), "doc_id", hash_filter(wanted, DOC_BITS))
    held = stored(some.join(wanted, "doc_id", "left_semi"))

    def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differ = np.array([differing(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5))], np.int64)
                keep = differ * (100 + percent) <= (100 - percent) * (batch.column(2).to_numpy() + batch.column(3).to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = held.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), F.col("fine").alias("x"))
    right = held.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("m"), F.col("fine").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(allow, "a bigint, b bigint")


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole shingle sets are similar enough. The texts of all b meet their a; an a with many b is
    compared in several parts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, a, own = None, None, None
        for rows, hashes, counts in hashed_texts(batches, 4, lower=True):  # sorted by part, a's own text first
            kept = []
            for p, x, b, s in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), shingle_sets(hashes, counts, width)):
                if b == x:
                    part, a, own = p, x, s
                    continue
                assert (p, x) == (part, a)
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(s) - both):
                    kept.append((x, b))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = rows_in_filter(docs.select("doc_id", "text"), "doc_id", hash_filter(wanted, DOC_BITS))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    of_b = pairs.join(parts, "a").select(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("k"), "a", "b", F.lit(1).alias("late"), F.col("b").alias("doc_id"))
    of_a = parts.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"), "a", F.col("a").alias("b"), F.lit(0), F.col("a").alias("doc_id"))
    rows = of_b.union(of_a).join(some, "doc_id").select(F.xxhash64("a", "k").alias("part"), "a", "b", "late", "text")
    return rows.repartition("part").sortWithinPartitions("part", "a", "late").mapInArrow(compare, "a bigint, b bigint")


def one_of_each_id(docs: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(doc_id) of the ids that rows repeat, None if there are none, and ``docs`` with one row of each of them, that of the greatest text."""
    repeated = stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return None, docs
    greatest = docs.join(repeated, "doc_id").groupBy("doc_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("key"), *docs.columns)).alias("x"))
    return repeated, docs.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(greatest.select(*[F.col("x")[c].alias(c) for c in docs.columns]))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: the smallest doc_id reachable by links of at least ``percent`` % Jaccard similarity of ``width``-word shingle sets."""
    every = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    repeated, docs = one_of_each_id(every)
    heavy = frequent_shingles(every, width)
    signed = stored(signatures(every, width, percent, heavy))
    filled, chosen = signed, None
    if repeated is not None:
        chosen = stored(signatures(docs.join(repeated, "doc_id", "left_semi"), width, percent, heavy))  # the greatest texts of repeated ids
        filled = signed.join(repeated, "doc_id", "left_anti").unionByName(chosen)
    filled = filled.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    reps = filled.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("group_id").alias("group_id"))
    groups = reps.groupBy("group_id").agg(F.min("rep").alias("gid"), F.count("*").alias("members"))
    classes = stored(reps.join(groups, "group_id").select("set_id", "rep", "gid", "members"))
    sets = filled.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bitmap")
    members = stored(buckets(classes, filled, percent))
    tried = stored(candidate_pairs(members, sets, percent, forest=True))
    likely = finer(tried, filled, percent)
    first = stored(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))  # one partner each; the others follow if they still matter
    links = stored(verify(first, docs, width, percent))
    found = stored(connected_components(links))
    # only components at the ends of a forest's pair that is no link so far can still be joined
    unlinked = tried.join(links, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = stored(unlinked.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    open_ends = ends.select("component").distinct()
    labels = found.join(open_ends, "component", "left_semi").select("node", "component").union(ends.filter("node = component")).distinct()
    labelled = stored(members.join(labels.withColumnRenamed("node", "rep"), "rep"))
    mixed = labelled.groupBy("bucket", "own").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    labelled = labelled.join(mixed.select("bucket", "own"), ["bucket", "own"], "left_semi")
    more = candidate_pairs(labelled, sets, percent, forest=False).join(first, ["a", "b"], "left_anti")
    more = stored(finer(stored(more), filled, percent))
    if not more.isEmpty():
        links = stored(links.union(verify(more, docs, width, percent)))
        found = stored(connected_components(links))
    named = stored(classes.select("set_id", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component")))
    out = signed.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    of_id = F.coalesce("component", "doc_id")
    if chosen is not None:
        by_id = chosen.join(named, "set_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("of_id"))
        out, of_id = out.join(by_id, "doc_id", "left"), F.coalesce("of_id", "component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), of_id).alias("component_id"))
