"""Operator 13: source divergence audit by three-dimensional cube partitioning.

Each language keeps the terms of at least ``min_docs`` of its documents. Every (language, source) group and every language is a
smoothed distribution p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)) over the V kept terms, and two of them differ by the sum of
floor((p - q)^2 / (p + q)).

1. Terms are counted inside tasks, in tables of ``HELD_TERMS`` entries that are emitted when full; a shuffle sums them, so a word that
   stands everywhere is one row of each task.
2. A language's groups fall into blocks of ``group_block`` by hash, its terms into blocks of ``term_block``. A task owns the cell
   (group block, group block, term block): each slice of counts is replicated to the cells of its group block, nothing else is. A
   cell holds two matrices of at most about ``group_block`` times ``term_block`` values whatever the input.
3. Cells add up the partial divergences of their pairs; terms that a group lacks count with its least p, terms of the block that
   no group of the cell has are counted without being listed. Partial values are summed along the term axis.

All pairs of a language's groups are the result itself. All arithmetic is in whole numbers. A hot source is at most one row for each
term behind the first shuffle.

Defined cases: null text, lang or source is the empty string; a group without kept terms still has its pairs, and with V = 0 their
value is 0; ties rank by item; repeated rows and doc_ids count as they stand; an empty table yields no rows; very long texts are
counted whole; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Groups and terms of a block; (term, group) entries that a task holds while counting.
GROUP_BLOCK, TERM_BLOCK, HELD_TERMS = 64, 1 << 14, 500_000
#: Parts of a language's terms where they meet the language's row.
SALTS = 64
#: Bytes of terms: ASCII letters, lower-cased, and all bytes of other characters; the rest are blanks.
_TERM_BYTES = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def term_counts(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences and documents of each term in each group, and a row with a null term for each group."""
    source = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")])

    def rows(tables: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> pa.RecordBatch:
        lang, origin, term, n, n_docs = [], [], [], [], []
        for (a, b), (counts, found) in tables.items():
            lang += [a] * (len(counts) + 1)
            origin += [b] * (len(counts) + 1)
            term += [None, *counts]
            n += [0, *counts.values()]
            n_docs += [0, *(found[t] for t in counts)]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.binary()) for x in (lang, origin, term)), pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())], ["lang", "source", "term", "n", "n_docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, size = {}, 0
        for batch in batches:
            for lang, origin, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                counts, found = tables.setdefault((lang, origin), (Counter(), Counter()))
                size -= len(counts) - 1
                terms = text.translate(_TERM_BYTES).split()
                counts.update(terms)
                found.update(set(terms))
                size += len(counts)
                if size > held:
                    yield rows(tables)
                    tables, size = {}, 0
        if tables:
            yield rows(tables)

    counted = source.mapInArrow(count, "lang binary, source binary, term binary, n bigint, n_docs bigint")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    return summed.withColumns({c: F.col(c).cast("string") for c in ("lang", "source", "term")})


def _share(n: str, total: str) -> Column:
    """p of a count, exact: the product may pass 64 bits."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10,0)) * ({n} + 2)) div ({total} + 2 * n_terms)")


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one cell. Rows: the groups' least p (null term) and their terms' p."""
    lang, a, b = key[0], key[1].as_py(), key[2].as_py()
    least = table.filter(pc.is_null(table.column("term")))
    held = table.filter(pc.is_valid(table.column("term")))
    names, block, floor = least.column("source").to_pylist(), least.column("block").to_numpy(), least.column("p").to_numpy()
    row = pc.index_in(held.column("source"), least.column("source").combine_chunks()).to_numpy(zero_copy_only=False)
    terms = held.column("term").combine_chunks().dictionary_encode()
    share = np.repeat(floor[:, None], len(terms.dictionary), axis=1)
    share[row, terms.indices.to_numpy()] = held.column("p").to_numpy()
    unlisted = least.column("n_block")[0].as_py() - len(terms.dictionary)
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    out: list[tuple[str, str, int]] = []
    for g in left.tolist():
        values = _divergence(share[right], share[g]).sum(axis=1) + unlisted * _divergence(floor[right], floor[g])
        for h, value in zip(right.tolist(), values.tolist(), strict=True):
            if g != h:
                out.append((names[g], names[h], value))
                if a != b:
                    out.append((names[h], names[g], value))
    columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
    return pa.table([pa.array([lang.as_py()] * len(out), pa.string()), *columns], ["lang", "source", "item", "value"])


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: a group's divergence from each other source of its language; part
    ``term``: the ``top`` terms that a group has more often than its language, by their share of that divergence."""
    counts = stored(term_counts(docs))
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    kept = stored(kept.drop("n_docs"))
    slices = stored(counts.drop("n_docs").join(kept, ["lang", "term"]))
    languages = counts.filter("term IS NULL").groupBy("lang").agg(F.count("*").alias("n_groups"))
    languages = languages.join(kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    blocks = {"group_blocks": F.ceil(F.col("n_groups") / group_block), "term_blocks": F.greatest(F.ceil(F.col("n_terms") / term_block), F.lit(1))}
    languages = languages.fillna(0, ["n_terms", "lang_total"]).withColumns(blocks)
    totals = slices.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(languages, "lang")
    groups = stored(groups.withColumn("block", F.pmod(F.xxhash64("source"), "group_blocks")).withColumn("least", F.when(F.col("n_terms") > 0, _share("0", "total")).otherwise(1)))

    term_at = F.pmod(F.xxhash64("term"), "term_blocks")
    placed = slices.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total"), "q": _share("lang_n", "lang_total"), "term_at": term_at})
    salted = languages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a language may hold most terms
    in_block = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).groupBy("lang", term_at.alias("term_at")).agg(F.count("*").alias("n_block"))
    markers = groups.withColumn("term_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("term_blocks") - 1))).join(in_block, ["lang", "term_at"], "left")
    columns = ["lang", "source", "block", "term_at", "group_blocks", "term", "p", "n_block"]
    markers = markers.withColumns({"term": F.lit(None).cast("string"), "p": F.col("least"), "n_block": F.coalesce("n_block", F.lit(0))}).select(*columns)
    replicated = markers.union(placed.withColumn("n_block", F.lit(None).cast("bigint")).select(*columns))
    replicated = replicated.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("group_blocks") - 1)))
    cells = replicated.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "term_at", "source", "block", "term", "p", "n_block")
    partial = cells.groupBy("lang", "a", "b", "term_at").applyInArrow(_cell, "lang string, source string, item string, value bigint")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = placed.filter((F.col("p") > F.col("q")) & (F.col("n") > 0)).select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    telling = above.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumns({"rank": F.row_number().over(by_value), "part": F.lit("pair")}).select(*out).union(telling.withColumn("part", F.lit("term")).select(*out))
