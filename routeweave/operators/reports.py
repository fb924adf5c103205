"""Rows behind reports: attributes with fallbacks, nested records, filters, timelines, segments and checks of published rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_text(*texts: Column) -> Column:
    """The first text that is not empty, else the empty one."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def with_attributes(df: DataFrame, asn: str, names: DataFrame) -> DataFrame:
    """Adds ``as_name``: the local name of ``names`` (asn, name_local, name_en), else the English one, else empty. A number of the form
    ``public_private`` is looked up by its public part."""
    keyed = df.withColumn("__asn", F.split(F.col(asn).cast("string"), "_")[0])
    dim = names.select(F.col("asn").cast("string").alias("__asn"), "name_local", "name_en")
    return keyed.join(dim, "__asn", "left").withColumn("as_name", first_text(F.col("name_local"), F.col("name_en"))).drop("__asn", "name_local", "name_en")


def path_observations(df: DataFrame, keys: Sequence[str], snapshots: str) -> DataFrame:
    """A row for each path of a JSON object of lists by time: (keys, observed, ordinal, as_path, path_id)."""
    parsed = F.from_json(snapshots, "map<string, array<string>>")
    times = df.select(*keys, F.explode(parsed).alias("observed", "paths")).select(*keys, "observed", F.posexplode("paths").alias("ordinal", "as_path"))
    return times.withColumn("path_id", record_id(F.lit("path"), F.col("as_path")))


def record_id(*parts: Column) -> Column:
    """Identity of a record by its file hash, record and element, or any other parts: their SHA-256, NULL parts marked."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]), 256)


def unnested(df: DataFrame, keys: Sequence[str], payload: str, schema: str) -> DataFrame:
    """Child rows of a JSON array with their ordinal; a parent without any, or with a broken payload, keeps one row of NULLs."""
    items = df.select(*keys, F.posexplode_outer(F.from_json(payload, f"array<{schema}>")).alias("ordinal", "item"))
    return items.select(*keys, "ordinal", "item.*")


def text_filter(df: DataFrame, columns: Sequence[str], text: str, classes: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """Rows of which one of the columns holds a text, whatever the case, and whose classes are among the given ones."""
    keep = F.contains(F.lower(F.concat_ws("\n", *[F.col(c) for c in columns])), F.lit(text.lower()))
    for column, allowed in classes.items():
        keep &= F.col(column).isin(*allowed)
    return df.filter(keep)


def mapped_routes(routes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Routes (origin, origin_state) with ``country`` of ``mapping`` (asn, country) and the reason for which a row is left out, if one is."""
    joined = routes.join(mapping.select(F.col("asn").alias("origin"), "country"), "origin", "left")
    reason = F.when(F.col("origin_state") != "resolved", F.concat(F.lit("origin_"), "origin_state")).when(F.col("country").isNull(), "unmapped_country")
    return joined.withColumn("reason", reason)


def state_timelines(df: DataFrame, keys: Sequence[str], slot: str, state: str) -> DataFrame:
    """The states of each key as text in slot order, runs of one state written once with their length; and the slots in each state."""
    w = Window.partitionBy(*keys).orderBy(slot)
    fresh = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(w)).groupBy(*keys, "__run", state).agg(F.count("*").alias("n"), F.min(slot).alias("__first"))
    listed = F.sort_array(F.collect_list(F.struct("__run", F.col(state).alias("s"), "n")))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws("*", x["s"], x["n"].cast("string"))), " ").alias("timeline"), F.count("*").alias("n_runs"), F.sum("n").alias("n_slots"))


def state_summary(df: DataFrame, keys: Sequence[str], slot: str, state: str, names: Sequence[str]) -> DataFrame:
    """Slots in each named state, the longest run of each, and the state at the end."""
    w = Window.partitionBy(*keys).orderBy(slot)
    fresh = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)
    rows = df.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(w))
    runs = rows.groupBy(*keys, "__run", state).agg(F.count("*").alias("n"), F.max(slot).alias("__last"))
    return runs.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col(state) == x, F.col("n"))), F.lit(0)).alias(f"n_{x}") for x in names],
        *[F.coalesce(F.max(F.when(F.col(state) == x, F.col("n"))), F.lit(0)).alias(f"longest_{x}") for x in names], F.max_by(state, "__last").alias("end_state"),
    )


def segment_summary(df: DataFrame, segments: DataFrame, key: str, slot: str, value: str) -> DataFrame:
    """Lowest, highest and summed values, and observed and missing slots, between the anchors of ``segments`` (key, segment, first_slot, last_slot)."""
    inside = segments.join(df, key).filter(F.col(slot).between(F.col("first_slot"), F.col("last_slot")))
    return inside.groupBy(key, "segment").agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.sum(value).alias("total"), F.count(value).alias("observed"), F.count_if(F.col(value).isNull()).alias("missing"))


def metric_series(df: DataFrame, keys: Sequence[str], slot: str, metrics: Sequence[str]) -> DataFrame:
    """One row for each metric and slot: the value, its change, its share of the first one, and whether it is the series' lowest (the
    earliest of equal ones)."""
    long = df.unpivot([*keys, slot], list(metrics), "metric", "value")
    w = Window.partitionBy(*keys, "metric").orderBy(slot)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("value", ignorenulls=True).over(whole)
    lowest = F.row_number().over(Window.partitionBy(*keys, "metric").orderBy(F.asc_nulls_last("value"), slot)) == 1
    return long.select(*keys, slot, "metric", "value", (F.col("value") - F.lag("value").over(w)).alias("delta"), F.when(first != 0, F.col("value") / first).alias("share"), (lowest & F.col("value").isNotNull()).alias("is_lowest"))


def quarantined(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Adds ``reasons``, all that hold, in order and joined by commas; empty for a sound row."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons.items()]))
    return df.withColumn("reasons", F.array_join(found, ","))


def duration_checks(df: DataFrame, start: str, end: str, claimed: str, tolerance: int = 0) -> DataFrame:
    """consistent, inconsistent, open (no end) or reversed: is the claimed duration that of the two times?"""
    taken = F.col(end) - F.col(start)
    state = F.when(F.col(end).isNull(), "open").when(taken < 0, "reversed").when(F.abs(taken - F.col(claimed)) <= tolerance, "consistent").otherwise("inconsistent")
    return df.withColumns({"taken": taken, "duration_check": state})


def gap_classes(missing: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Missing slots (key, slot) as source_unavailable inside a declared gap (key, gap_from, gap_to), else processing_gap."""
    gaps = declared.groupBy(key).agg(F.collect_set(F.struct("gap_from", "gap_to")).alias("gaps"))  # declared by hand: few for a source
    inside = F.exists("gaps", lambda g: (F.col("slot") >= g["gap_from"]) & (F.col("slot") < g["gap_to"]))
    return missing.join(gaps, key, "left").select(key, "slot", F.when(F.coalesce(inside, F.lit(False)), "source_unavailable").otherwise("processing_gap").alias("grid_class"))


def closure_checks(df: DataFrame, total: str, parts: Sequence[str], ratios: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Do the classes of an observation add up to its baseline, and is each ratio that of its counts? A check on NULLs is not_checked."""

    def verdict(holds: Column) -> Column:
        return F.when(holds.isNull(), "not_checked").when(holds, "holds").otherwise("broken")

    add = lambda names: sum((F.col(p) for p in names[1:]), F.col(names[0]))
    checks = {"classes": verdict(add(list(parts)) == F.col(total))}
    for ratio, (over, under) in ratios.items():
        checks[ratio] = verdict(F.abs(F.col(ratio) - add(list(over)) / F.col(under)) < 1e-9)
    return df.withColumns({f"{name}_check": c for name, c in checks.items()})


@F.pandas_udf(T.LongType())
def covered_blocks(prefixes: pd.Series) -> int:
    """Aggregate function: /24 blocks that a group's IPv4 prefixes cover. The group has to fit in a task; ``intervals.v4_blocks`` has no such bound."""
    import ipaddress

    spans = []
    for text in prefixes.dropna().unique():
        try:
            net = ipaddress.IPv4Network(text, strict=False)
        except ValueError:
            continue
        if net.prefixlen:
            spans.append((int(net.network_address) >> 8, int(net.broadcast_address) >> 8))
    total, end = 0, -1
    for low, high in sorted(spans):
        total += max(0, high - max(low, end + 1) + 1)
        end = max(end, high)
    return total


def allocated(df: DataFrame, country: str, asn: str, n: int) -> DataFrame:
    """The ``n`` countries with most different networks, with their rank."""
    counts = df.groupBy(country).agg(F.count_distinct(asn).alias("n_asns"))
    top = counts.orderBy(F.desc("n_asns"), country).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_asns"), country)))
