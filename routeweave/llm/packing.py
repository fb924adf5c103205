"""Operator 1: lexical retrieval packing.

Texts are encoded once and their ids written, with the document frequencies of the vocabulary. Each document is *routed* by
its rarest terms: first the rarest of the terms that a sixteenth of all documents have, then of less common ones, last of
all that another document has (``LEVELS``). A range partitioning by these
terms, and by a hash of the id behind them, brings documents with the same telling terms side by side wherever they were
read, and cuts the rows into parts of equal size: a hot term, or a group of copies, is spread over as many parts as it
fills. A part holds one full shard at least, whatever ``spark.sql.shuffle.partitions`` says. The sorted parts are cut into *shards* of at most ``shard_docs`` documents (or
``SHARD_TOKENS`` ids).

A shard has its own BM25 inverted index over token ids. A seed document opens a window; all its terms query the index,
and the best unused neighbours fill the window greedily, the last one being cut so that the window is full. The cut tail
opens the next window, so no token is lost or repeated and only the last window of a shard can hold padding. A task's
memory is bounded by one shard and one text. What reaches the driver is a number for each id of the vocabulary.

Defined cases: a null text is empty and yields the separator alone; a very long text fills windows of its own and its
tail is packed with others; an empty table yields no rows; repeated rows, and rows that repeat a doc_id, are packed once
each; ties in score go to the earlier document of the shard, those of routing terms to the earlier in the text; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

WINDOW, SEPARATOR = 2048, 1
SHARD_DOCS, SHARD_TOKENS = 2048, 2_000_000
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Least share of all documents that have a routing term, level by level.
LEVELS = (1 / 16, 1 / 128, 0.0)
#: Most bytes of ids that a part has on average.
PART_BYTES = 64 << 20
#: Terms that more than this share of a shard's documents have are kept as rows of one number for each document.
COMMON = 1 / 16

SCHEMA = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Texts with other characters, or with a special token's string, are encoded by ``tokenizers`` itself.
_PLAIN = re.compile(r"[\n -~\u00a1-\u024f\u2018-\u201d\u2013\u2014]*")
_SPECIAL = "<|"


class Tokenizer:
    """Byte-level BPE ids of whole texts as little-endian unsigned 32-bit bytes.

    The ids are those of the ``tokenizers`` file at ``path``. Where ``ranks_path`` names the same vocabulary as ranks,
    plain texts go through ``tiktoken``, which gives the same ids several times faster.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Bpe

        self._exact, self._fast = Bpe.from_file(path), None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self._fast and _SPECIAL not in text and _PLAIN.fullmatch(text):
            ids = self._fast.encode_ordinary(text)
        else:
            ids = self._exact.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()


class Bm25Shard:
    """Inverted index of one shard: postings by term with their BM25 weight for a query that names the term once."""

    def __init__(self, documents: list[np.ndarray], query_terms: int | None = None):
        n = self.n = len(documents)
        lengths = np.array([len(d) for d in documents], dtype=np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int64), lengths)
        tokens = np.concatenate(documents).astype(np.int64) if n else np.zeros(0, np.int64)
        key, tf = np.unique(tokens * n + owner, return_counts=True)  # by term, then by document
        term, doc = key // max(n, 1), key % max(n, 1)
        terms, df = np.unique(term, return_counts=True)
        self.start = np.concatenate(([0], np.cumsum(df)))
        slot = np.repeat(np.arange(len(terms)), df)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if n else 1, 1e-9))
        self.doc = doc
        self.weight = idf[slot] * tf * (K1 + 1) / (tf + norm[doc])
        common = df > max(1, COMMON * n)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), n), np.float32)
        often = common[slot]
        self.rows[self.row[slot[often]], doc[often]] = self.weight[often]
        # a document's query: its terms that another document of the shard has, rarest first
        shared = np.flatnonzero(df[slot] > 1)
        order = shared[np.lexsort((slot[shared], -idf[slot[shared]], doc[shared]))]
        self.query_start = np.searchsorted(doc[order], np.arange(n + 1))
        self.query_slot, self.query_terms = slot[order], query_terms

    def scores(self, seed: int) -> np.ndarray:
        slots = self.query_slot[self.query_start[seed] : self.query_start[seed + 1]][: self.query_terms]
        rows = self.row[slots]
        total = self.rows[rows[rows >= 0]].sum(axis=0, dtype=np.float64)
        spans = [slice(self.start[s], self.start[s + 1]) for s in slots[rows < 0].tolist()]
        if spans:
            total += np.bincount(np.concatenate([self.doc[x] for x in spans]), np.concatenate([self.weight[x] for x in spans]), self.n)
        return total


def pack_shard(documents: list[np.ndarray], window: int, query_terms: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece. ``documents``: ids with their separator. ``query_terms``: how many of a seed's rarest shared terms ask for neighbours; all if ``None``."""
    index, pieces, sequence = Bm25Shard(documents, query_terms), [], 0
    begin = [0] * len(documents)
    unused = np.ones(len(documents), dtype=bool)
    for d, ids in enumerate(documents):  # windows that one document fills alone
        while len(ids) - begin[d] >= window:
            pieces.append((d, begin[d], window, sequence, 0))
            begin[d] += window
            sequence += 1
        unused[d] = begin[d] < len(ids)
    following, tail = 0, None
    while True:
        if tail is None:
            while following < len(documents) and not unused[following]:
                following += 1
            if following == len(documents):
                return pieces
        seed = following if tail is None else tail
        tail, filled, chosen, scores = None, 0, seed, None
        while True:
            take = min(len(documents[chosen]) - begin[chosen], window - filled)
            pieces.append((chosen, begin[chosen], take, sequence, filled))
            begin[chosen] += take
            filled += take
            unused[chosen] = begin[chosen] < len(documents[chosen])
            if filled == window:
                tail = chosen if unused[chosen] else None
                break
            if scores is None:
                scores = np.where(unused, index.scores(seed), -1.0)
            scores[chosen] = -1.0
            chosen = int(scores.argmax())  # with no neighbour left, the first unused document
            if scores[chosen] < 0:
                break
        sequence += 1


def id_type(tokenizer_path: str) -> str:
    """Two bytes for an id where the vocabulary allows it."""
    from tokenizers import Tokenizer as Bpe

    return "<u2" if Bpe.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def encode(docs: DataFrame, tokenizer_path: str, ranks_path: str | None, pattern: str | None, separator: int, dtype: str) -> DataFrame:
    """(doc_id, ids, term, n): each row's ids with the separator behind them; and, without doc_id and ids, for each task in how
    many of its documents a term stands. Term -1 has the documents."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, df, n = Tokenizer(tokenizer_path, ranks_path, pattern), np.zeros(1, np.int64), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some, rows = batch.slice(k, 512), []
                for text in some.column(1).to_pylist():
                    ids = np.append(np.frombuffer(tokens(text or ""), "<u4"), np.uint32(separator)).astype(dtype)
                    rows.append(ids.tobytes())
                    ids = np.sort(ids)
                    if ids[-1] >= len(df):
                        df = np.concatenate([df, np.zeros(int(ids[-1]) + 1 - len(df), np.int64)])
                    df[ids[np.concatenate(([True], ids[1:] != ids[:-1]))]] += 1
                    n += 1
                nulls = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, pa.binary()), nulls, nulls], names=["doc_id", "ids", "term", "n"])
        terms = np.flatnonzero(df)
        size = len(terms) + 1
        counts = [pa.array(np.append(terms, -1)), pa.array(np.append(df[terms], n))]
        yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), *counts], names=["doc_id", "ids", "term", "n"])

    rows = docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))
    return rows.mapInArrow(encoded, "doc_id bigint, ids binary, term bigint, n bigint")


def term_frequencies(encoded: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each id stands, and the number of documents: a row for each id of the vocabulary."""
    rows = encoded.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(rows["term"].tolist(), rows["n"].tolist()))
    n = found.pop(-1, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return df, n


def routed(encoded: DataFrame, dtype: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(doc_id, ids, t0, t1, ...): for each level a document's rarest term that has its share of documents; -1 where there is none."""
    df, n = term_frequencies(encoded)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = encoded.sparkSession.sparkContext.broadcast([np.where((df > 1) & (df >= share * n), idf, 0) for share in levels])  # numbers for each id of the vocabulary
    names = [f"t{k}" for k in range(len(levels))]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.full((len(levels), batch.num_rows), -1, np.int32)
            for k, ids in enumerate(_ids(batch.column(1), dtype)):
                for level, idf in enumerate(shared.value):
                    weight = idf[ids]
                    at = int(weight.argmax())
                    if weight[at] > 0:
                        best[level, k] = ids[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, best)], names=["doc_id", "ids", *names])

    own = encoded.filter("ids IS NOT NULL").select("doc_id", "ids")
    return own.mapInArrow(route, "doc_id bigint, ids binary, " + ", ".join(f"{name} int" for name in names))


def _ids(column: pa.Array, dtype: str) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer(x.as_buffer(), dtype=dtype)


def part_count(n_docs: int, n_bytes: int, id_bytes: int, partitions: int, shard_docs: int = SHARD_DOCS) -> int:
    """Parts of at most ``PART_BYTES`` on average; up to the session's ``partitions`` where each still has a full shard, so that no setting
    makes shards small or leaves a padded window in each of many small parts."""
    full = max(n_docs // shard_docs, n_bytes // (SHARD_TOKENS * id_bytes))
    return max(1, math.ceil(n_bytes / PART_BYTES), min(partitions, full))


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, window: int = WINDOW, separator: int = SEPARATOR, shard_docs: int = SHARD_DOCS, query_terms: int | None = None) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): its ids, its place in the document and in a sequence of at most ``window`` ids."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        names, documents, size = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(1), dtype)):
                names.append(doc_id)
                documents.append(ids)
                size += len(ids)
                if len(names) >= shard_docs or size >= SHARD_TOKENS:
                    yield names, documents
                    names, documents, size = [], [], 0
        if names:
            yield names, documents

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        for names, documents in shards(batches):
            pieces = pack_shard(documents, window, query_terms)
            for k in range(0, len(pieces), 4096):
                some = pieces[k : k + 4096]
                columns = [
                    pa.array([names[p[0]] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.int64()),
                    pa.array([documents[p[0]][p[1] : p[1] + p[2]].astype("<u4").tobytes() for p in some], pa.binary()), pa.array([len(documents[p[0]]) for p in some], pa.int64()),
                    pa.array([first + p[3] for p in some], pa.int64()), pa.array([p[4] for p in some], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])
            first += pieces[-1][3] + 1 if pieces else 0

    dtype = id_type(tokenizer_path)
    encoded = stored(encode(docs, tokenizer_path, ranks_path, pattern, separator, dtype))
    n_bytes, n_docs = encoded.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)), F.count("ids")).first()
    parts = part_count(n_docs, n_bytes, np.dtype(dtype).itemsize, shuffle_partitions(docs.sparkSession), shard_docs)
    keys = [*(f"t{k}" for k in range(len(LEVELS))), "tie", "doc_id"]
    rows = routed(encoded, dtype).withColumn("tie", F.xxhash64("doc_id")).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return rows.select("doc_id", "ids").mapInArrow(pack, SCHEMA)
