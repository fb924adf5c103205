"""Frozen country populations and what is visible of them, slot by slot.

Routes are rows (vp, afi, prefix, origin_state, origin); a population member is a route of the seed snapshot whose origin is
resolved and belongs to the country. Everything is joins and aggregates on the route key; a slot that is not continuous
yields NULL in every measure, never zero.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUTE = ("vp", "afi", "prefix")
#: Parts of the slots of a window, by which they meet the members.
SLOT_PARTS = 16


def freeze_cohort(entries: DataFrame, membership: DataFrame) -> DataFrame:
    """The seed routes (vp, afi, prefix, origin) of members. ``membership``: (asn, member), NULL where the mapping is in doubt."""
    known = entries.filter("origin_state = 'resolved'").join(membership.filter("member").select(F.col("asn").alias("origin")), "origin")
    return known.select(*ROUTE, "origin").distinct()


def cohort_quality(entries: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: routes kept, and those left out by reason."""
    joined = entries.join(membership.select(F.col("asn").alias("origin"), "member", F.lit(True).alias("mapped")), "origin", "left")
    resolved = F.col("origin_state") == "resolved"
    return joined.agg(
        F.count_if(resolved & F.col("member")).alias("members"), F.count_if(F.col("origin_state") == "unknown").alias("unknown_origin"),
        F.count_if(F.col("origin_state") == "conflict").alias("conflict_origin"), F.count_if(resolved & F.col("mapped") & F.col("member").isNull()).alias("mapping_unknown"),
        F.count_if(resolved & (F.col("mapped").isNull() | ~F.col("member"))).alias("non_target"),
    )


def cohort_sizes(cohort: DataFrame) -> DataFrame:
    """Routes and different prefixes of each member and address family."""
    return cohort.groupBy("origin", "afi").agg(F.count("*").alias("routes"), F.count_distinct("prefix").alias("prefixes"))


def growing_members(seed: DataFrame, later: DataFrame, keys: Sequence[str], at: str, start: int) -> DataFrame:
    """(keys, first_seen): seed members count from ``start``, others only from the first time they are seen."""
    both = seed.select(*keys, F.lit(start).cast("bigint").alias("first_seen")).union(later.select(*keys, F.col(at).cast("bigint")))
    return both.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"))


def member_classes(cohort: DataFrame, current: DataFrame) -> DataFrame:
    """(slot, origin, routes, visible, class) of each member and family in each slot: a route is visible with the origin it had.
    ``current``: routes with ``slot``; a slot without any route of the country has to be in it with NULL route columns."""
    slots = current.select("slot").distinct()
    sizes = cohort_sizes(cohort).select("origin", "afi", "routes")
    same = current.select("slot", *ROUTE, "origin").distinct().join(cohort, [*ROUTE, "origin"])
    seen = same.groupBy("slot", "origin", "afi").agg(F.count("*").alias("visible"))
    every = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SLOT_PARTS - 1))))
    grid = every.join(slots.withColumn("part", F.pmod(F.hash("slot"), F.lit(SLOT_PARTS))), "part").drop("part")
    out = grid.join(seen, ["slot", "origin", "afi"], "left").withColumn("visible", F.coalesce("visible", F.lit(0)))
    kind = F.when(F.col("visible") == 0, "fully_invisible").when(F.col("visible") < F.col("routes"), "partially_visible").otherwise("fully_visible")
    return out.withColumn("class", kind)


def observations(classes: DataFrame, continuity: DataFrame) -> DataFrame:
    """One row for each slot: members by class over both families, those whose IPv4 alone is gone, ratios of affected and visible
    members and of visible routes; all NULL where ``continuity`` (slot, continuous) does not hold."""
    is_class = lambda name: F.col("class") == name
    own = classes.groupBy("slot", "origin").agg(
        F.count("*").alias("families"), F.count_if(is_class("fully_visible")).alias("full"), F.count_if(is_class("fully_invisible")).alias("none"), F.sum("routes").alias("routes"),
        F.sum("visible").alias("visible"), F.max((F.col("afi") == 4) & is_class("fully_invisible")).alias("no_v4"), F.max((F.col("afi") == 6) & ~is_class("fully_invisible")).alias("some_v6"),
    )
    full, none = F.col("full") == F.col("families"), F.col("none") == F.col("families")
    sums = own.groupBy("slot").agg(
        F.count("*").alias("baseline_asns"), F.count_if(full).alias("fully_visible"), F.count_if(none).alias("fully_invisible"), F.count_if(~full & ~none).alias("partially_visible"),
        F.count_if(F.col("no_v4") & F.col("some_v6")).alias("only_v6"), F.sum("routes").alias("baseline_routes"), F.sum("visible").alias("visible_routes"),
    )
    joined = sums.join(continuity, "slot", "left")
    known = lambda c: F.when(F.col("continuous"), c)
    return joined.select(
        "slot", "baseline_asns", "baseline_routes", *[known(F.col(c)).alias(c) for c in ("fully_visible", "partially_visible", "fully_invisible", "only_v6", "visible_routes")],
        known((F.col("partially_visible") + F.col("fully_invisible")) / F.col("baseline_asns")).alias("affected_ratio"),
        known((F.col("partially_visible") + F.col("fully_visible")) / F.col("baseline_asns")).alias("visible_ratio"), known(F.col("visible_routes") / F.col("baseline_routes")).alias("route_ratio"),
        F.when(F.coalesce(F.col("continuous"), F.lit(False)), None).otherwise("input_gap").alias("reason"),
    )


def dynamic_members(cohort: DataFrame, current: DataFrame, membership: DataFrame) -> DataFrame:
    """Country networks seen in a slot that are not of the frozen population, kept apart: (slot, afi, asns, prefixes)."""
    new = current.join(membership.filter("member").select(F.col("asn").alias("origin")), "origin").join(cohort.select("origin").distinct(), "origin", "left_anti")
    return new.groupBy("slot", "afi").agg(F.count_distinct("origin").alias("asns"), F.count_distinct("prefix").alias("prefixes"))


def trend_profile(df: DataFrame, keys: Sequence[str], slot: str, state: str) -> DataFrame:
    """complete, degraded or unavailable: how many slots of a series were observed, and whether its ends were."""
    seen = F.col(state) == "observed"
    out = df.groupBy(*keys).agg(F.count("*").alias("expected"), F.count_if(seen).alias("observed"), F.min_by(seen, slot).alias("start_observed"), F.max_by(seen, slot).alias("end_observed"))
    status = F.when(F.col("observed") == F.col("expected"), "complete").when(F.col("observed") == 0, "unavailable").otherwise("degraded")
    limits = F.filter(
        F.array(F.when(status == "unavailable", "no_observed_slots").when(status == "degraded", "non_observed_slots_present"), F.when(~F.col("start_observed"), "window_start_not_observed"), F.when(~F.col("end_observed"), "window_end_not_observed")),
        lambda x: x.isNotNull(),
    )
    return out.withColumns({"status": status, "limitations": F.array_join(limits, ",")})


def severity(affected: Column, route_ratio: Column) -> Column:
    """The larger of the affected share and the share of routes gone; NULL where one is unknown."""
    return F.when(affected.isNotNull() & route_ratio.isNotNull(), F.greatest(affected, 1 - route_ratio))


def _next_rise(x: np.ndarray, floor: float, confirm: int) -> int | None:
    """The first place of ``x`` from which ``confirm`` values in a row are at least ``floor`` above the least value since the highest one so far."""
    top = np.maximum.accumulate(x)
    tops = np.append(True, x[1:] >= top[:-1])
    since = pd.Series(np.where(tops, np.nan, x)).groupby(np.cumsum(tops)).cummin()
    least = since.groupby(np.cumsum(tops)).shift().to_numpy()
    held = pd.Series(x[::-1]).rolling(confirm).min().to_numpy()[::-1]
    found = np.flatnonzero(~tops & (x >= least) & (held >= least + floor))
    return int(found[0]) if len(found) else None


def waves(df: DataFrame, keys: Sequence[str], slot: str, value: str, floor: float, confirm: int = 2) -> DataFrame:
    """Waves inside each episode by its severity: after a recovery below the peak so far, ``confirm`` slots in a row that are
    ``floor`` above the best recovery begin a new one. An episode with an unknown severity has none. Grouped map over an episode, one pass over arrays for each wave."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(slot, kind="stable")
        at, x, starts = pdf[slot].to_numpy(), pdf[value].to_numpy(np.float64, na_value=np.nan), [0]
        rows = []
        if not np.isnan(x).any():
            while (step := _next_rise(x[starts[-1] :], floor, confirm)) is not None:
                starts.append(starts[-1] + step)
            for n, (begin, end) in enumerate(zip(starts, [*starts[1:], len(x)], strict=True), 1):
                rows.append((*(pdf[k].iloc[0] for k in keys), n, at[begin], at[begin + int(x[begin:end].argmax())], at[end - 1]))
        return pd.DataFrame(rows, columns=[*keys, "ordinal", "onset", "peak", "end"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "ordinal bigint, onset bigint, peak bigint, end bigint"])
    return df.select(*keys, slot, value).groupBy(*keys).applyInPandas(one, schema)
