"""Digests of tables that add up, as a tree over key ranges: two large tables are compared by their digests, and only ranges that differ are read.

A row's digest is the MD5 of its columns as text, kept as two whole numbers of 60 bits; a table's is their sums and the number of rows, so parts can be put together or taken off and order plays no
part. A row's section is given by leading hexadecimal digits of the MD5 of its key, so sections are ranges of hashed keys of about equal size whatever the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a section: 16 ** DEPTH sections at most, whatever the table.
DEPTH = 3
_SEPARATOR, _NULL = "\x1f", "\x01"


def row_text(columns: Sequence[str]) -> Column:
    """The columns as text, NULL told apart from empty."""
    return F.concat_ws(_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in columns])


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")


def _sums(digest: str) -> list[Column]:
    total = lambda start: F.coalesce(F.sum(_half(F.col(digest), start).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    return [F.count("*").alias("n_rows"), total(1).alias("high"), total(16).alias("low")]


def digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (n_rows, high, low) of a whole table."""
    return df.select(F.md5(row_text(columns)).alias("__digest")).agg(*_sums("__digest"))


def section(keys: Sequence[str], depth: int = DEPTH) -> Column:
    return F.substring(F.md5(row_text(keys)), 1, depth)


def section_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """(level, node, n_rows, high, low) of every section and of the ranges above it, up to the whole table (level 0, node ''). Rows are summed once, by section;
    the levels above are sums of at most ``16 ** depth`` rows."""
    leaves = df.select(section(keys, depth).alias("__section"), F.md5(row_text(columns)).alias("__digest")).groupBy("__section").agg(*_sums("__digest"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    nodes = leaves.select("*", levels).withColumn("node", F.expr("substring(__section, 1, level)"))
    return nodes.groupBy("level", "node").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) if c != "n_rows" else F.sum(c).alias(c) for c in ("n_rows", "high", "low")])


def tree_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, node, rows_a, rows_b, status) of the ranges that differ: ``only_a``, ``only_b`` or ``differs``. A range differs if and only if one below it does, so
    the deepest rows are all that has to be read."""
    left = a.select("level", "node", F.col("n_rows").alias("rows_a"), F.struct("n_rows", "high", "low").alias("a"))
    right = b.select("level", "node", F.col("n_rows").alias("rows_b"), F.struct("n_rows", "high", "low").alias("b"))
    both = left.join(right, ["level", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    status = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("differs")
    return both.select("level", "node", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"), status.alias("status"))


def differing_sections(a: DataFrame, b: DataFrame, depth: int = DEPTH) -> list[str]:
    """The sections of two trees that differ, in order: at most ``16 ** depth``."""
    return sorted(r["node"] for r in tree_difference(a.filter(F.col("level") == depth), b.filter(F.col("level") == depth)).select("node").collect())


def publish(df: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str], depth: int = DEPTH) -> None:
    """Write a table with one folder for each section, and its tree beside it."""
    placed = df.withColumn("section", section(keys, depth))
    placed.repartition("section").write.mode("errorifexists").partitionBy("section").parquet(f"{path}/rows")
    section_tree(df, keys, columns, depth).write.mode("errorifexists").parquet(f"{path}/tree")


def published_difference(spark: SparkSession, a: str, b: str, columns: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """(columns, side) of the rows that one of two published tables has more often. The trees are compared first; of the tables only the folders of sections that differ are read."""
    trees = [spark.read.parquet(f"{x}/tree") for x in (a, b)]
    names = differing_sections(*trees, depth)
    rows = [spark.read.option("basePath", f"{x}/rows").schema(spark.read.parquet(f"{x}/rows").schema).parquet(f"{x}/rows").filter(F.col("section").cast("string").isin(names)).select(*columns) for x in (a, b)]
    return row_difference(*rows)


def row_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often, once for each time more, with the side. Both sides are counted by row before they meet, so a repeated row is one row in the shuffle."""
    columns = a.columns
    both = a.withColumn("__d", F.lit(1)).union(b.select(*columns).withColumn("__d", F.lit(-1))).groupBy(*columns).agg(F.sum("__d").alias("__d")).filter("__d <> 0")
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs(F.col("__d")))).alias("__k")
    return both.select(*columns, F.when(F.col("__d") > 0, "only_a").otherwise("only_b").alias("side"), times).drop("__k")


def reconcile_states(anchor: DataFrame, replayed: DataFrame, keys: Sequence[str], projection: Sequence[str], depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """A snapshot against a replay of updates to the same time, on columns that neither provenance nor time of arrival changes.

    (one row: status ``consistent`` or ``mismatch``, rows and differing sections of how many; the rows that differ, with their side: read from differing sections only)
    """
    columns = [*keys, *projection]
    trees = [section_tree(x, keys, columns, depth) for x in (anchor, replayed)]
    names = differing_sections(*trees, depth)
    sizes = [t.filter("level = 0").select(F.lit(0).alias("k"), F.col("n_rows").alias(n)) for t, n in zip(trees, ("rows_anchor", "rows_replayed"), strict=True)]
    used = trees[0].union(trees[1]).filter(F.col("level") == depth).agg(F.count_distinct("node").alias("sections"), F.lit(0).alias("k"))
    report = used.join(sizes[0], "k", "left").join(sizes[1], "k", "left").na.fill(0).drop("k").withColumns({"differing": F.lit(len(names)).cast("bigint"), "status": F.lit("mismatch" if names else "consistent")})
    near = [x.select(*columns).filter(section(keys, depth).isin(names)) for x in (anchor, replayed)]
    return report, row_difference(*near)
