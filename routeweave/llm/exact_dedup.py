"""Operator 12: exact dedup by an exchange of Golomb-coded fingerprints.

1. Rows are read once, cut into parts (the rows of one task, ``PART_ROWS`` at most) and written to a table bucketed by part:
   normalised text, its SHA-256 and its length. The table is what every later step reads, so a row's place in its part never
   changes, whatever executors are lost.
2. Each part sends every owner of a range of fingerprints its sorted different fingerprints as one Golomb-coded message. A
   fingerprint is as many leading bits of the digest as the number of rows needs, so that one row in ``SPARE`` is suspected falsely.
   A value that one part holds a thousand times is sent once.
3. An owner decodes its messages (``OWNER_ROWS`` values at most, on average), and answers each with a bitmap of the values
   that other parts sent too.
4. Each part turns its answers, and its own repeats, into a bitmap of suspect places. The bitmaps meet the table by bucket, so
   texts that nobody shares are never shuffled.
5. Suspects are grouped by digest and whole text, which is the byte verification. Copies within a task are combined before
   the shuffle, so one text that a third of all rows hold is one row of each task. Rows learn their class by their digest.

Defined cases: a null text is empty; rows whose texts are empty after normalising are copies of each other; rows that repeat a
doc_id are rows of their own; a null doc_id counts as larger than all others; of rows equal in length and doc_id the first read
stays; an empty table yields no rows; a very long text is one row; extra columns, whatever their names, are left out. Two
different texts with one SHA-256 stop the job with an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import BLANKS, discard, scratch_dir, shuffle_partitions, stored

#: Most rows of a part, most values that an owner gets on average, and one row in how many is suspected falsely (a power of two).
PART_ROWS, OWNER_ROWS, SPARE = 1 << 20, 1 << 22, 1 << 12
#: Values for an owner below which fewer owners than shuffle partitions are used.
LEAST_OWNER_ROWS = 1 << 12
_BLANK_BYTES = BLANKS.encode()
MESSAGE = "owner int, part bigint, n int, k int, unary binary, rest binary"
ANSWER = "part bigint, owner int, shared binary"


def _fingerprinted(docs: DataFrame, part_rows: int) -> DataFrame:
    """(part, pos, fp, digest, doc_id, n_chars, body); fp: the first 63 bits of the SHA-256 of body."""
    source = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            bodies = [raw.translate(None, _BLANK_BYTES) for raw in batch.column(2).to_pylist()]
            digests = [hashlib.sha256(body).digest() for body in bodies]
            place = np.arange(done, done + len(bodies))
            done += len(bodies)
            fps = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4)[:, 0] >> np.uint64(1)
            columns = [task + place // part_rows, (place % part_rows).astype(np.int32), fps.astype(np.int64), digests, batch.column(0), batch.column(1), bodies]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["part", "pos", "fp", "digest", "doc_id", "n_chars", "body"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(rows, f"part bigint, pos int, fp bigint, digest binary, doc_id {kind}, n_chars int, body binary")


class Exchange:
    """The messages of parts to owners and their answers. width: bits of a fingerprint that are sent; owners: how many there are."""

    def __init__(self, n_rows: int, partitions: int, owner_rows: int = OWNER_ROWS, spare: int = SPARE):
        self.width = min(63, n_rows.bit_length() + spare.bit_length() - 1)
        self.owners = max(1, -(-n_rows // owner_rows), min(partitions, n_rows // LEAST_OWNER_ROWS))

    def _sent(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(owner, values sent to it in order, the rows' index among all values in order of rows); rows: those with fingerprints of the owner."""
        owner = ((fps >> 32) * self.owners) >> 31
        value = (fps >> (63 - self.width)).astype(np.uint64)
        order = np.argsort(fps, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(self.owners + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            rows = order[bounds[k] : bounds[k + 1]]
            yield k, value[rows], rows

    def send(self, table: pa.Table) -> pa.Table:
        part, out = table.column("part")[0].as_py(), []
        for owner, values, _ in self._sent(table.column("fp").to_numpy()):
            values = np.unique(values)
            out.append((owner, part, len(values), *golomb.encode(values)))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["owner", "part", "n", "k", "unary", "rest"])

    @staticmethod
    def answer(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        streams = (table.column(x).to_pylist() for x in ("k", "unary", "rest"))
        values = np.concatenate([golomb.decode(n, *x) for n, *x in zip(sizes, *streams, strict=True)])
        _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
        bits = np.split(counts[which] > 1, np.cumsum(sizes)[:-1])
        answers = table.select(["part", "owner"]).append_column("shared", pa.array([np.packbits(x).tobytes() for x in bits], pa.binary()))
        return answers.filter(pa.array([bool(x.any()) for x in bits]))

    def mark(self, rows: pa.Table, answers: pa.Table) -> pa.Table:
        """One row: the part and 64-bit words with bit pos % 64 of word pos // 64 set for each suspect; none if there is none."""
        told = dict(zip(answers.column("owner").to_pylist(), answers.column("shared").to_pylist(), strict=True))
        pos, suspects = rows.column("pos").to_numpy(), []
        for owner, values, at in self._sent(rows.column("fp").to_numpy()):
            _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
            hit = counts > 1
            if owner in told:
                hit |= np.unpackbits(np.frombuffer(told[owner], np.uint8), count=len(hit)) > 0
            suspects.append(pos[at[hit[which]]])
        suspects = np.concatenate(suspects) if suspects else np.zeros(0, np.int32)
        if not len(suspects):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))], ["part", "words"])
        bits = np.zeros((int(suspects.max()) // 64 + 1) * 64, np.uint8)
        bits[suspects] = 1
        words = np.packbits(bits, bitorder="little").view("<i8")
        return pa.table([rows.column("part").slice(0, 1), pa.array([words], pa.list_(pa.int64()))], ["part", "words"])


def _is_suspect(words: str, pos: str) -> Column:
    at = F.col(pos).cast("int")
    return F.coalesce(F.getbit(F.get(words, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1, F.lit(False))


def exact_groups(docs: DataFrame, part_rows: int = PART_ROWS, owner_rows: int = OWNER_ROWS, spare: int = SPARE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks; of equal ones the row with the most code points, then the smallest
    doc_id, stays.
    """
    spark, root = docs.sparkSession, scratch_dir(docs.sparkSession)
    name, buckets = f"fingerprinted_{uuid.uuid4().hex}", shuffle_partitions(spark)
    rows = _fingerprinted(docs, part_rows).write.bucketBy(buckets, "part").option("path", f"{root}/{name}").option("compression", "zstd")
    try:
        rows.saveAsTable(name)
        table = spark.table(name)
        exchange = Exchange(table.count(), buckets, owner_rows, spare)
        places = table.select("part", "pos", "fp")
        messages = places.groupBy("part").applyInArrow(lambda part: exchange.send(part), MESSAGE)
        answers = messages.groupBy("owner").applyInArrow(Exchange.answer, ANSWER)
        words = stored(places.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda own, told: exchange.mark(own, told), "part bigint, words array<bigint>"))
        marked = table.join(words.hint("shuffle_hash"), "part", "left").withColumn("suspect", _is_suspect("words", "pos")).drop("words", "fp")
        best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "part", "pos"))
        verified = marked.filter("suspect").groupBy("digest", "body").agg(F.count("*").alias("n"), best.alias("best"))
        classes = verified.groupBy(F.col("digest").alias("class")).agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("best").alias("best"))
        classes = stored(classes)
        rows = stored(marked.drop("body", "n_chars"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, f"{root}/{name}")
    size = F.when(F.col("texts") > 1, F.raise_error(F.concat(F.lit("different texts with the SHA-256 "), F.hex("class")))).otherwise(F.col("n"))
    text_sha256 = F.lower(F.hex("digest")).alias("text_sha256")
    single = rows.filter(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), text_sha256)
    first = (F.col("part") == F.col("best.part")) & (F.col("pos") == F.col("best.pos"))
    suspects = rows.filter("suspect").join(classes, F.col("digest") == F.col("class"))
    return single.union(suspects.select("doc_id", F.col("best.doc_id").alias("keep_id"), size.cast("bigint").alias("group_size"), first.alias("kept"), text_sha256))
