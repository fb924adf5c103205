"""Feature series and relations derived from route state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefixes import v4_ancestors


def slot_counts(events: DataFrame, keys: Sequence[str], order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Announcements, withdrawals and prefixes of each origin in each slot. A withdrawal belongs to the last origin its key had."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("asn", F.coalesce("origin", F.last("origin", ignorenulls=True).over(w))).filter("asn IS NOT NULL")
    return rows.groupBy(slot, "asn").agg(F.count_if(F.col("action") == "announce").alias("announces"), F.count_if(F.col("action") == "withdraw").alias("withdraws"), F.count_distinct("prefix").alias("prefixes"))


def level_counts(events: DataFrame, slot: str, group: str) -> DataFrame:
    """The same counts by group and over all groups at once; prefixes are distinct at each level, not summed."""
    sets = events.groupingSets([[F.col(slot), F.col(group)], [F.col(slot)]], slot, group)
    return sets.agg(F.when(F.grouping(group) == 1, "collector").otherwise(group).alias("level"), F.count_if(F.col("action") == "announce").alias("announces"), F.count_if(F.col("action") == "withdraw").alias("withdraws"), F.count_distinct("prefix").alias("prefixes"))


def origin_relation(routes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vantage points and origins of each prefix, and whether it has several origins."""
    out = routes.groupBy(*keys).agg(F.count_distinct("vp").alias("n_vps"), F.count_distinct("origin").alias("n_origins"), F.min("origin").alias("first_origin"))
    return out.withColumn("moas", F.col("n_origins") > 1)


def running_metrics(events: DataFrame, subject: Sequence[str], keys: Sequence[str], order: Sequence[str], slot: str) -> DataFrame:
    """Per slot counts of changes and the routes visible at its end: deltas are summed by slot first, then run."""
    own = Window.partitionBy(*keys).orderBy(*order)
    rows = events.withColumn("up", F.when(F.col("action") != "withdraw", 1).otherwise(0))
    rows = rows.withColumn("change", F.col("up") - F.coalesce(F.lag("up").over(own), F.lit(0)))
    slots = rows.groupBy(*subject, slot).agg(F.sum("change").alias("change"), F.count_if(F.col("action") == "announce").alias("announces"), F.count_if(F.col("action") == "withdraw").alias("withdraws"))
    w = Window.partitionBy(*subject).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    return slots.select(*subject, slot, "announces", "withdraws", F.sum("change").over(w).alias("visible"))


def nearest_covering(nets: DataFrame, table: DataFrame, key: str, ancestors: Callable[[Column, Column], Column] = v4_ancestors) -> DataFrame:
    """The longest shorter prefix of ``table`` (network, length) that covers each of ``nets`` (key, network, length): ``ancestors`` are
    exploded (at most 31 for IPv4, one for each length of the table for IPv6) and met by equality, so no range join is needed."""
    up = nets.select(key, F.explode(ancestors(F.col("network"), F.col("length"))).alias("a")).select(key, F.col("a.network").alias("network"), F.col("a.length").alias("length"))
    met = up.join(table.select("network", "length").distinct(), ["network", "length"])
    return met.groupBy(key).agg(F.max_by("network", F.col("length")).alias("parent_network"), F.max("length").alias("parent_length"))


def resource_counts(routes: DataFrame, time: str, collector: str, tracked: Sequence, values: dict[str, Column]) -> DataFrame:
    """How many different values of each kind a snapshot has, over all collectors and for each tracked one. ``values``: an array
    column for each kind. Kinds are counted as rows, so no row is expanded by several distinct counts at once."""
    def named(kind: str, column: Column) -> Column:
        return F.transform(column.cast("array<string>"), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    kinds = F.flatten(F.array(*[named(kind, c) for kind, c in values.items()]))
    buckets = F.array_compact(F.array(F.lit("global"), F.when(F.col(collector).isin(*tracked), F.col(collector).cast("string"))))
    rows = routes.select(time, buckets.alias("b"), F.explode(kinds).alias("x")).select(time, F.explode("b").alias("bucket"), "x.kind", "x.value").filter("value IS NOT NULL")
    counted = rows.distinct().groupBy(time, "bucket").pivot("kind", list(values)).agg(F.count("value"))
    return counted.na.fill(0, list(values))


def vp_resources(routes: DataFrame, time: str, vp: str, names: DataFrame) -> DataFrame:
    """Different prefixes of each vantage point in each snapshot, with its name (empty if unknown) and rank. ``names``: (asn, as_name, as_rank)."""
    counts = routes.select(time, vp, "prefix").distinct().groupBy(time, vp).agg(F.count("*").alias("prefixes"))
    joined = counts.join(names.withColumnRenamed("asn", vp), vp, "left")
    return joined.select(time, vp, F.coalesce("as_name", F.lit("")).alias("as_name"), "as_rank", "prefixes")
