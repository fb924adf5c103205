"""Intervals, islands and grids: the shared forms of coverage, runs, gaps and concurrency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefixes import parse_cidr, v4_parts


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching half-open intervals of each key joined into one; a NULL end is open and stays open."""
    far = F.lit((1 << 62)).cast("bigint")
    rows = df.select(*keys, F.col(start).alias("__s"), F.coalesce(F.col(end), far).alias("__e"))
    order = Window.partitionBy(*keys).orderBy("__s", "__e")
    before = F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__fresh", F.when(before >= F.col("__s"), 0).otherwise(1)).withColumn("__island", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(*keys, "__island").agg(F.min("__s").alias(start), F.max("__e").alias("__e"), F.count("*").alias("n_merged"))
    return merged.select(*keys, start, F.when(F.col("__e") < far, F.col("__e")).alias(end), "n_merged")


def covered(df: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """Size of the union of closed integer ranges of each key, without listing their members."""
    rows = df.select(*keys, low.alias("low"), (high + 1).alias("high")).filter("low IS NOT NULL").distinct()
    return merge_intervals(rows, keys, "low", "high").groupBy(*keys).agg(F.sum(F.col("high") - F.col("low")).cast("bigint").alias("covered"))


def v4_blocks(df: DataFrame, keys: Sequence[str], prefix: str, bits: int = 24) -> DataFrame:
    """Distinct blocks of ``bits`` network bits that a set of IPv4 prefixes touches; the default route is left out."""
    size = 1 << (32 - bits)
    rows = df.select(*keys, prefix).distinct().withColumn("p", v4_parts(F.col(prefix))).filter("p.length > 0")
    low, high = F.floor(F.col("p.network") / size).cast("bigint"), F.floor((F.col("p.network") + F.col("p.size") - 1) / size).cast("bigint")
    return covered(rows, keys, low, high).withColumnRenamed("covered", "blocks")


def v6_blocks_48(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Distinct /48 blocks that a set of IPv6 prefixes touches; the default route and other text are left out."""
    rows = df.select(*keys, prefix).distinct().withColumn("c", parse_cidr(prefix)).filter("c.afi = 6 AND c.plen > 0")
    low = F.floor(F.col("c.hi") / (1 << 16)).cast("bigint")
    size = F.pow(F.lit(2.0), F.greatest(48 - F.col("c.plen"), F.lit(0))).cast("bigint")
    return covered(rows.select(*keys, low.alias("l"), size.alias("n")), keys, F.col("l"), F.col("l") + F.col("n") - 1).withColumnRenamed("covered", "blocks")


def v4_addresses(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Size of the union of addresses and its equivalent in /24 blocks, which may be a fraction."""
    rows = df.select(*keys, prefix).distinct().withColumn("p", v4_parts(F.col(prefix))).filter("p.length > 0")
    out = covered(rows, keys, F.col("p.network"), F.col("p.network") + F.col("p.size") - 1)
    return out.select(*keys, F.col("covered").alias("addresses"), (F.col("covered") / 256).alias("equivalent_24"))


def slot_grid(bounds: DataFrame, keys: Sequence[str], first: str, last: str, step: int) -> DataFrame:
    """One row for each slot from ``first`` to ``last`` of each row."""
    return bounds.select(*keys, F.explode(F.sequence(F.col(first), F.col(last), F.lit(step))).alias("slot"))


def missing_ranges(df: DataFrame, keys: Sequence[str], slot: str, step: int) -> DataFrame:
    """(first_missing, last_missing, n_missing) ranges between the present slots of each key."""
    w = Window.partitionBy(*keys).orderBy(slot)
    rows = df.select(*keys, slot).distinct().withColumn("next", F.lead(slot).over(w))
    gap = rows.filter(F.col("next") - F.col(slot) > step)
    return gap.select(*keys, (F.col(slot) + step).alias("first_missing"), (F.col("next") - step).alias("last_missing"), ((F.col("next") - F.col(slot)) / step - 1).cast("bigint").alias("n_missing"))


def runs_of(df: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """(state, first, last, n) of each run of rows with equal state."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("changed", F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run", state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def longest_runs(df: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    return runs_of(df, keys, order, state).groupBy(*keys, state).agg(F.max("n").alias("longest"), F.sum("n").alias("total"))


def transitions(df: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """(from_at, at, from_state, to_state) where a state changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({"from_at": F.lag(order).over(w), "from_state": F.lag(state).over(w)})
    return rows.filter(F.col("from_at").isNotNull() & ~F.col("from_state").eqNullSafe(F.col(state))).select(*keys, "from_at", F.col(order).alias("at"), "from_state", F.col(state).alias("to_state"))


def concurrent_at(df: DataFrame, start: str, end: str, step: int, subject: str) -> DataFrame:
    """Subjects with an open interval at each multiple of ``step``: overlaps of one subject are merged, then +1 and -1 are
    summed by the first grid point that each change reaches, so nothing is listed for every point an interval lasts."""
    merged = merge_intervals(df, [subject], start, end)
    reach = lambda c: F.ceil(F.col(c) / step).cast("bigint") * step
    ups = merged.select(reach(start).alias("at"), F.lit(1).alias("d"))
    downs = merged.filter(F.col(end).isNotNull()).select(reach(end).alias("at"), F.lit(-1).alias("d"))
    change = ups.union(downs).groupBy("at").agg(F.sum("d").alias("d"))
    # the running sum of one global series: sums of days first, then inside each day
    day = F.floor(F.col("at") / 86400).cast("bigint")
    days = change.groupBy(day.alias("day")).agg(F.sum("d").alias("d"))
    before = days.select("day", (F.sum("d").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("d")).alias("before"))
    inside = Window.partitionBy("day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return change.withColumn("day", day).join(before, "day").select("at", (F.col("before") + F.sum("d").over(inside)).alias("active"))
