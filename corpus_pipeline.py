"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a DataFrame
that is written as Parquet and read again. All stages but the last return the columns of ``documents``; other columns are
dropped, whatever their names. An empty table passes through all stages; a very long text is handled whole by each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeweave.llm import jaccard_join, language_id, line_dedup, mixing, packing
from routeweave.llm.common import stored, table
from routeweave.llm.queries import tokenizer_files

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of words that must have a document's language; near-duplicates by five-word shingles, in percent.
LEAST_SCORE, SHINGLE_WORDS, SIMILAR_PERCENT = 0.5, 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or of which no language has half the words, go; ``lang`` becomes
    the language found. Repeated rows are judged alike; of languages with equal shares the first in the alphabet counts."""
    named = language_id.language_id(docs)
    kept = named.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents stay in the largest doc_id, rows of one doc_id counting each; documents that had words
    and have none left go, those that had none stay."""
    kept = line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.filter((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != "")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, of rows that repeat a doc_id the one of the
    greatest text. Documents without words, and those with a null doc_id, stay."""
    groups = jaccard_join.jaccard_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    others = groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id")
    _, single = jaccard_join.one_of_each_id(docs)
    return single.join(others, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked source, language and topic shares. Documents without words go; null values are one value; rows of
    one doc_id share their fate."""
    return mixing.mix(docs).filter("sampled").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: every row of ``docs`` whole, repeated rows and empty texts too."""
    return packing.pack_documents(docs, *tokenizer_files())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: A trained model, components and a packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
