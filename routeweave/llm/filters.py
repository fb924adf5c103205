"""Bitmaps of bounded size that drop rows before a shuffle; a join behind them gives the exact answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter of documents: 2 MB. With more documents than bits it drops fewer rows, and results stay the same.
DOC_BITS = 1 << 24
#: Bits set for each value of a ``bloom_filter``.
PLACES = 4
#: Positions in one row of Spark's ``bitmap_construct_agg``.
_ROW_BITS = 32768


def hash_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``bits`` bits with bit h mod ``bits`` set for each value of the only column."""
    at = F.pmod(F.col(hashes.columns[0]), F.lit(bits)) + 1
    rows = hashes.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).repartition("b")
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toLocalIterator():  # at most ``bits`` bits in all
        start = (row["b"] - 1) * _ROW_BITS // 8
        out[start : start + len(row["m"])] = np.frombuffer(row["m"], np.uint8)[: len(out) - start]
    return out


def in_filter(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bloom_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of ``bits`` bits (a power of two, at most 2**40) with ``PLACES`` bits set for each value of the only column."""
    h = F.col(hashes.columns[0])
    low, step = h.bitwiseAND(F.lit((1 << 40) - 1)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1).cast("bigint"))
    places = F.array(*[(low + i * step).bitwiseAND(F.lit(bits - 1).cast("bigint")) for i in range(PLACES)])
    return hash_filter(hashes.select(F.explode(places)), bits)


def in_bloom(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``h`` of the values that may be in a filter made by ``bloom_filter``."""
    mask = np.uint64(len(bitmap) * 8 - 1)
    left = np.arange(len(h))
    low, step = h & np.uint64((1 << 40) - 1), (h >> np.uint64(33)) | np.uint64(1)
    for i in range(PLACES):
        at = (low + np.uint64(i) * step) & mask
        hit = (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        left, low, step = left[hit], low[hit], step[hit]
    return left


def rows_in_filter(df: DataFrame, column: str, bitmap: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose bigint ``column`` may be in the filter."""
    shared, at = df.sparkSession.sparkContext.broadcast(bitmap), df.columns.index(column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(in_filter(shared.value, h)))

    return df.mapInArrow(keep, df.schema)
