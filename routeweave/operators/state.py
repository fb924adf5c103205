"""Route state in batch: replay, snapshots, visibility intervals, gaps, and the outage and hijack lifecycles built on them.

A route key is collector, vantage point, family and prefix, or any columns named as ``keys``. Events of a key are ordered
by ``order`` columns (time, then ordinals). State is never held in a loop: every function is windows, aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import collapse_prepends
from .intervals import merge_intervals
from .joins import RELATIONS, best_relations


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by map-side combined ``max_by``: no key's rows are gathered."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return latest.select(*keys, "x.*")


def replay(events: DataFrame, keys: Sequence[str], order: Sequence[str], action: str = "action") -> DataFrame:
    """Current routes: an announcement replaces its key's entry and a withdrawal deletes only that."""
    return last_per_key(events, keys, order).filter(F.col(action) != "withdraw")


def order_conflicts(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keys whose events share an order key, which replay must not guess about."""
    return events.groupBy(*keys, *order).agg(F.count("*").alias("n")).filter("n > 1")


def visibility(events: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, carry: Sequence[str] = (), action: str = "action") -> DataFrame:
    """[from_at, to_at) intervals in which a key has a route; the last one is open. Each announcement opens one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = events.withColumn("to_at", F.lead(at).over(w))
    shown = rows.filter(F.col(action) != "withdraw").filter(F.col("to_at").isNull() | (F.col("to_at") > F.col(at)))
    return shown.select(*keys, *carry, F.col(at).alias("from_at"), "to_at")


def visible_at(intervals: DataFrame, slots: DataFrame, buckets: int = 64) -> DataFrame:
    """Intervals joined to the slots (slot) in which they hold at the slot's start. The time of the slots is cut in ``buckets``, an
    interval stands in those that it touches, and the two meet by bucket: no interval is compared with slots far away."""
    seen = slots.agg(F.min("slot").alias("low"), F.max("slot").alias("high")).first()
    low, high = seen["low"] or 0, seen["high"] or 0
    width = (high - low) // buckets + 1
    bucket = lambda c: F.floor((c - low) / width).cast("bigint")
    first, last = F.greatest(F.col("from_at"), F.lit(low)), F.least(F.coalesce("to_at", F.lit(high)), F.lit(high))
    near = intervals.filter((F.col("from_at") <= high) & (F.col("to_at").isNull() | (F.col("to_at") > low)))
    near = near.withColumn("__bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    met = near.join(slots.withColumn("__bucket", bucket(F.col("slot"))), "__bucket").drop("__bucket")
    return met.filter((F.col("from_at") <= F.col("slot")) & (F.col("to_at").isNull() | (F.col("to_at") > F.col("slot"))))


def slot_populations(intervals: DataFrame, slots: DataFrame, subject: Sequence[str], item: str, step: int) -> DataFrame:
    """(slot, subject, routes, items): how many intervals of a subject hold at the start of each of ``slots`` (slot, multiples of ``step``), and of how many different items; no row where none does.

    An interval is +1 at the first slot that it reaches and -1 at the first behind it, whatever lies between; intervals of one item are joined first. So a long interval is two rows, and slots are only listed where a result row stands.
    """
    reach = lambda c: (F.ceil(F.col(c) / step) * step).cast("bigint")
    held = intervals.select(*subject, item, reach("from_at").alias("first"), reach("to_at").alias("behind")).filter("behind IS NULL OR behind > first")
    merged = merge_intervals(held, [*subject, item], "first", "behind")
    ends = lambda df, r, i: df.select(*subject, F.explode(F.array(F.struct(F.col("first").alias("slot"), F.lit(r).alias("r"), F.lit(i).alias("i")), F.struct(F.col("behind").alias("slot"), F.lit(-r).alias("r"), F.lit(-i).alias("i")))).alias("x"))
    changes = ends(held, 1, 0).union(ends(merged, 0, 1)).select(*subject, "x.*").filter("slot IS NOT NULL").groupBy(*subject, "slot").agg(F.sum("r").alias("r"), F.sum("i").alias("i"))
    series = Window.partitionBy(*subject).orderBy("slot")
    now = {c: F.sum(c).over(series.rowsBetween(Window.unboundedPreceding, 0)) for c in ("r", "i")}
    runs = changes.withColumns(now | {"next": F.lead("slot").over(series)}).filter("r > 0")
    last = slots.agg(F.max("slot")).first()[0] or 0
    listed = runs.withColumn("until", F.coalesce(F.col("next") - step, F.lit(last))).filter("until >= slot")
    shown = listed.select(*subject, F.explode(F.sequence("slot", "until", F.lit(step).cast("bigint"))).alias("slot"), F.col("r").alias("routes"), F.col("i").alias("items"))
    return shown.join(slots.select("slot").distinct(), "slot", "left_semi")


def running_visible(events: DataFrame, subject: Sequence[str], key: Sequence[str], order: Sequence[str], at: str, action: str = "action") -> DataFrame:
    """After each change: how many of a subject's keys are visible, and how many were ever seen. A key counts once while visible."""
    own = Window.partitionBy(*subject, *key).orderBy(*order)
    up = F.when(F.col(action) != "withdraw", 1).otherwise(0)
    rows = events.withColumn("up", up).withColumns({"before": F.coalesce(F.lag("up").over(own), F.lit(0)), "fresh": F.when(F.row_number().over(own) == 1, 1).otherwise(0)})
    rows = rows.withColumn("change", F.col("up") - F.col("before")).filter("change <> 0 OR fresh = 1")
    so_far = Window.partitionBy(*subject).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*subject, *order, *([at] if at not in order else []), F.sum("change").over(so_far).alias("visible"), F.sum("fresh").over(so_far).alias("seen"))


def hysteresis(df: DataFrame, subject: Sequence[str], order: Sequence[str], starts: Column, ends: Column) -> DataFrame:
    """Adds ``down``: 1 from a row that meets ``starts`` until one that meets ``ends``; the two must not hold at once."""
    mark = F.when(starts, 1).when(ends, 0)
    so_far = Window.partitionBy(*subject).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("down", F.coalesce(F.last(mark, ignorenulls=True).over(so_far), F.lit(0)))


def prefix_outages(events: DataFrame, subject: Sequence[str], key: Sequence[str], order: Sequence[str], at: str, least_seen: int = 3, recovered: float = 0.4) -> DataFrame:
    """Events of subjects of which all of at least ``least_seen`` keys are gone, until ``recovered`` of them are back."""
    counts = running_visible(events, subject, key, order, at)
    judged = hysteresis(counts, subject, order, (F.col("visible") == 0) & (F.col("seen") >= least_seen), F.col("visible") >= recovered * F.col("seen"))
    runs = runs_with_next(judged, subject, order, at, "down")
    return runs.filter("down = 1").select(*subject, F.col("first").alias("start_at"), F.col("next_first").alias("end_at"), F.col("seen").alias("seen_at_start"))


def runs_with_next(df: DataFrame, subject: Sequence[str], order: Sequence[str], at: str, state: str) -> DataFrame:
    """Rows where a state begins, with the time at which the next one begins."""
    w = Window.partitionBy(*subject).orderBy(*order)
    begins = df.withColumn("prior", F.lag(state).over(w)).filter(F.col("prior").isNull() | (F.col("prior") != F.col(state)))
    return begins.withColumn("next_first", F.lead(at).over(w)).withColumnRenamed(at, "first").drop("prior")


def ratio_outages(counts: DataFrame, subject: Sequence[str], order: Sequence[str], at: str, lost: str, total: str, start: float = 0.2, end: float = 0.85) -> DataFrame:
    """AS outages: more than ``start`` of the prefixes lost opens one, more than ``end`` present closes it; the peak is kept."""
    ratio = F.when(F.col(total) > 0, F.col(lost) / F.col(total))
    judged = hysteresis(counts.withColumn("ratio", ratio), subject, order, F.col("ratio") > start, (1 - F.col("ratio")) > end)
    w = Window.partitionBy(*subject).orderBy(*order)
    rows = judged.withColumn("fresh", F.when((F.col("down") == 1) & (F.coalesce(F.lag("down").over(w), F.lit(0)) == 0), 1).otherwise(0))
    rows = rows.withColumns({"outage": F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.lead(at).over(w)}).filter("down = 1")
    return rows.groupBy(*subject, "outage").agg(
        F.min(at).alias("start_at"), F.max_by("after", F.struct(*order)).alias("end_at"), F.max(lost).alias("peak_lost"), F.max("ratio").alias("peak_ratio"), F.min_by(at, F.struct(-F.col("ratio"), F.col(at))).alias("peak_at")
    )


def origin_sets(events: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, origin: str, per: Sequence[str]) -> DataFrame:
    """After each event of a prefix, its origins over all vantage points: each origin's visible routes are counted by +1 and -1."""
    own = Window.partitionBy(*keys, *per).orderBy(*order)
    rows = events.withColumn("was", F.lag(origin).over(own)).filter(~F.col("was").eqNullSafe(F.col(origin)))
    changes = rows.select(*keys, *order, F.explode(F.filter(F.array(F.struct(F.col("was").alias("origin"), F.lit(-1).alias("d")), F.struct(F.col(origin).alias("origin"), F.lit(1).alias("d"))), lambda x: x["origin"].isNotNull())).alias("x"))
    so_far = Window.partitionBy(*keys, "origin").orderBy(*order, "d").rowsBetween(Window.unboundedPreceding, 0)
    counted = changes.select(*keys, *order, "x.origin", "x.d").withColumn("routes", F.sum("d").over(so_far))
    turned = counted.withColumn("turn", F.when((F.col("d") == 1) & (F.col("routes") == 1), 1).when((F.col("d") == -1) & (F.col("routes") == 0), -1)).filter("turn IS NOT NULL")
    steps = turned.groupBy(*keys, *order).agg(F.sum("turn").alias("turn"))
    total = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*keys, *order, F.sum("turn").over(total).alias("origins"))


def moas_events(events: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, origin: str, per: Sequence[str]) -> DataFrame:
    """Times in which a prefix has several origins: opened by the step from one to more, closed by the step back; peak kept."""
    sets = origin_sets(events, keys, order, at, origin, per).withColumn("several", F.when(F.col("origins") > 1, 1).otherwise(0))
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = sets.withColumns({"fresh": F.when((F.col("several") == 1) & (F.coalesce(F.lag("several").over(w), F.lit(0)) == 0), 1).otherwise(0), "after": F.lead(at).over(w)})
    rows = rows.withColumn("number", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("several = 1")
    return rows.groupBy(*keys, "number").agg(F.min(at).alias("start_at"), F.max_by("after", F.struct(*order)).alias("end_at"), F.max("origins").alias("most_origins"))


def leak_triplets(paths: DataFrame, edges: DataFrame, known: DataFrame, path: str, prefix: Sequence[str], order: Sequence[str], skip: float = 0.2) -> DataFrame:
    """The first leak of each prefix: neighbours (first, second, third) on a path read from its origin, where the second has the
    route from one provider and gives it to another. Repeated hops are one; paths with an AS set, or of at most three hops, have
    none; ``edges`` (a, b, rel) are read with the precedence of ``relation_of``, and triplets with a stability of at least
    ``skip`` in a row of ``known`` (first_as, second_as, third_as, stability) are passed over."""
    rows = paths.filter(~F.contains(F.col(path), F.lit("{"))).select(*prefix, *order, collapse_prepends(F.split(F.col(path), " ")).alias("h")).filter(F.size("h") > 3)
    triplet = lambda i: F.struct((F.size("h") - 1 - i).alias("from_origin"), F.get("h", i).alias("first_as"), F.get("h", i - 1).alias("second_as"), F.get("h", i - 2).alias("third_as"))
    rows = rows.select(*prefix, *order, F.explode(F.transform(F.sequence(F.lit(2), F.size("h") - 1), triplet)).alias("__t")).select(*prefix, *order, "__t.*")
    provider = best_relations(edges).filter(F.col("place") == RELATIONS.index("provider_customer"))
    rows = rows.join(provider.select(F.col("a").alias("first_as"), F.col("b").alias("second_as")), ["first_as", "second_as"])
    rows = rows.join(provider.select(F.col("a").alias("third_as"), F.col("b").alias("second_as")), ["third_as", "second_as"])
    rows = rows.join(known.filter(F.col("stability") >= skip), ["first_as", "second_as", "third_as"], "left_anti")
    found = F.struct(*order, "from_origin", "first_as", "second_as", "third_as")
    return rows.groupBy(*prefix).agg(F.min(found).alias("x")).select(*prefix, "x.*")


def with_gaps(slots: DataFrame, gaps: DataFrame, keys: Sequence[str], slot: str, values: Sequence[str]) -> DataFrame:
    """After a key's first gap (keys, gap_from) nothing is known: values become NULL from that slot on, and a reason is given."""
    first = gaps.groupBy(*keys).agg(F.min("gap_from").alias("gap_from"))
    joined = slots.join(first, list(keys), "left")
    known = F.col("gap_from").isNull() | (F.col(slot) < F.col("gap_from"))
    out = joined.withColumns({v: F.when(known, F.col(v)) for v in values})
    return out.withColumn("reason", F.when(~known, "input_gap")).drop("gap_from")
