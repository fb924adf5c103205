"""Data quality and reconciliation: profiles, identity checks, collisions, digests and gates as DataFrames of findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_rows, n_null, n_empty, n_zero, n_distinct): one pass of counts, and different values column by column, so that
    no row is expanded and each of those scans reads its column alone."""
    aggs, distinct = [F.count("*").alias("n")], None
    for c in columns:
        x = F.col(c)
        aggs += [F.count_if(x.isNull()).alias(f"{c}_null"), F.count_if(x.cast("string") == "").alias(f"{c}_empty"), F.count_if(x.try_cast("double") == 0).alias(f"{c}_zero")]
        own = df.agg(F.count_distinct(x).alias("n_distinct")).select(F.lit(c).alias("column_name"), "n_distinct")
        distinct = own if distinct is None else distinct.union(own)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), *[F.col(f"{c}_{k}").alias(f"n_{k}") for k in ("null", "empty", "zero")]) for c in columns])
    return df.agg(*aggs).select(F.inline(rows)).join(distinct, "column_name")


def violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check_name, n_checked, n_failed): rows for which a check is false or unknown fail it."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col("n").alias("n_checked"), F.col(k).alias("n_failed")) for k in checks])))


def gate(found: DataFrame, blocking: Sequence[str]) -> DataFrame:
    """Adds verdict and blocking to the rows of ``violations``."""
    verdict = F.when(F.col("n_checked") == 0, "pending").when(F.col("n_failed") == 0, "pass").otherwise("fail")
    return found.withColumn("verdict", verdict).withColumn("blocking", (F.col("verdict") == "fail") & F.col("check_name").isin(*blocking))


def collisions(df: DataFrame, fact: Sequence[str], incident: str) -> DataFrame:
    """Facts that several incidents name."""
    found = df.groupBy(*fact).agg(F.count_distinct(incident).alias("n_incidents"), F.min(incident).alias("first_incident"), F.max(incident).alias("last_incident"))
    return found.filter("n_incidents > 1")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def first_valid(df: DataFrame, key: str, value: str, order: str, valid: Column) -> DataFrame:
    """The first valid row's value wins; how many rows agree, conflict and are invalid."""
    ranked = df.withColumn("ok", valid)
    first = ranked.groupBy(key).agg(F.min_by(F.when(F.col("ok"), F.col(value)), F.when(F.col("ok"), F.col(order))).alias("chosen"))
    both = ranked.join(first, key)
    same = F.col("ok") & F.col(value).eqNullSafe(F.col("chosen"))
    return both.groupBy(key).agg(F.first("chosen").alias("chosen"), F.count_if(same).alias("n_same"), F.count_if(F.col("ok") & ~same).alias("n_conflict"), F.count_if(~F.col("ok")).alias("n_invalid"))


def reconcile(claims: DataFrame, truth: DataFrame, key: Sequence[str], claimed: str, actual: str, tolerance: float = 0.0) -> DataFrame:
    """Claims against recomputed values: confirmed, revised or unverifiable."""
    joined = claims.join(truth, list(key), "left")
    verdict = F.when(F.col(actual).isNull(), "unverifiable").when(F.abs(F.col(claimed) - F.col(actual)) <= tolerance, "confirmed").otherwise("revised")
    return joined.select(*key, claimed, actual, verdict.alias("verdict"))
