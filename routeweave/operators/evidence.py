"""What was announced during an episode, and what moved beside a state: joins by time buckets and by the nearest sample, with a reason for each row left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Why a change is not attributed to an AS, and families that count.
WITHDRAW, CONFLICT, UNKNOWN, FOREIGN = "withdraw_origin_unavailable", "origin_conflict", "origin_unknown", "resolved_origin_not_in_cohort"
OTHER_ACTION, OTHER_FAMILY, NO_MEMBER, NO_EPISODE = "other_action", "other_family", "prefix_not_in_cohort", "outside_episodes"
ATTRIBUTED = "attributed"
FAMILIES = ("ipv4_unicast", "ipv6_unicast")
#: Seconds of a time bucket.
BUCKET = 6 * 3600


def attribute_changes(changes: DataFrame, episodes: DataFrame, members: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(route_event_id, cohort, episode, outcome, asn, candidates): what each route change of an episode's time proves.

    ``changes``: (route_event_id, at, family, action, prefix, origin_state, origins); ``episodes``: (episode, cohort, onset_at, end_at), end excluded and NULL while open; ``members``:
    (cohort, family, prefix, asn). An announcement with one resolved origin that is a member with that prefix is ``attributed`` to it; every other row says why not, with the number of
    member ASes that it leaves open. A change is one row for each cohort that has its prefix and episode that it falls into, and one row where there is none: nothing is lost.

    Changes and members meet by prefix; the two that are left meet episodes by cohort and time bucket, an episode standing in those that it touches, an open one in those up to the last change.
    """
    held = members.groupBy("cohort", "family", "prefix").agg(F.collect_set("asn").alias("asns"))
    usable = F.col("action").isin("announce", "withdraw") & F.col("family").isin(*FAMILIES)
    joined = changes.withColumn("key_prefix", F.when(usable, F.col("prefix"))).join(held.withColumnRenamed("prefix", "key_prefix"), ["family", "key_prefix"], "left")
    latest = changes.agg(F.max("at")).first()[0]
    stop = F.coalesce(F.col("end_at"), F.lit((latest or 0) + 1))
    spans = episodes.withColumn("stop", stop).filter("stop > onset_at")
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("onset_at") / bucket), F.floor((F.col("stop") - 1) / bucket)))).select("episode", F.col("cohort").alias("of"), "bucket", "onset_at", "stop")
    on = (F.col("cohort") == F.col("of")) & (F.floor(F.col("at") / bucket) == F.col("bucket")) & (F.col("at") >= F.col("onset_at")) & (F.col("at") < F.col("stop"))
    met = joined.join(spans, on, "left")
    one = F.size("origins") == 1
    outcome = (
        F.when(~F.coalesce(F.col("action").isin("announce", "withdraw"), F.lit(False)), OTHER_ACTION).when(~F.coalesce(F.col("family").isin(*FAMILIES), F.lit(False)), OTHER_FAMILY).when(F.col("cohort").isNull(), NO_MEMBER).when(F.col("episode").isNull(), NO_EPISODE)
        .when(F.col("action") == "withdraw", WITHDRAW).when(F.col("origin_state") == "conflict", CONFLICT).when(F.coalesce(F.col("origin_state"), F.lit("")) != "resolved", UNKNOWN)
        .when(one & F.array_contains("asns", F.get("origins", 0)), ATTRIBUTED).otherwise(FOREIGN)
    )
    told = met.withColumn("outcome", outcome)
    candidates = F.when(F.col("outcome").isin(WITHDRAW, CONFLICT, UNKNOWN), F.size("asns")).when(F.col("outcome").isin(ATTRIBUTED, FOREIGN), 1).otherwise(0)
    return told.select("route_event_id", "cohort", "episode", "outcome", F.when(F.col("outcome") == ATTRIBUTED, F.get("origins", 0)).alias("asn"), candidates.cast("bigint").alias("candidates"))


def attribution_counts(attributed: DataFrame) -> DataFrame:
    """(episode, outcome, changes, candidates)."""
    return attributed.groupBy("episode", "outcome").agg(F.count("*").alias("changes"), F.sum("candidates").alias("candidates"))


def lag_class(offset: Column) -> Column:
    """How far an activity is from a state, in slots: ``same_slot``, ``adjacent_slot``, ``lagged_slot``; ``unavailable`` without one."""
    return F.when(offset.isNull(), "unavailable").when(offset == 0, "same_slot").when(F.abs(offset) == 1, "adjacent_slot").otherwise("lagged_slot")


def direction(offset: Column) -> Column:
    return F.when(offset.isNull(), "unknown").when(offset == 0, "same_slot").when(offset > 0, "activity_after").otherwise("activity_before")


def align_tracks(states: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each state slot beside each track of its subject: the nearest observed sample at or before it and at or after it, their values, distances in slots and lag classes.

    ``states``: (subject, slot, state), ``tracks``: (subject, track, slot, value), a NULL value being unobserved; of several samples of a slot the largest counts. Both sides are one series for each
    (subject, track), read once in each direction; no state is compared with samples elsewhere. A track without an observed sample is ``unavailable`` everywhere.
    """
    samples = tracks.groupBy("subject", "track", "slot").agg(F.max("value").alias("value"))
    named = tracks.select("subject", "track").distinct()
    rows = states.join(named, "subject").select("subject", "track", "slot", "state", F.lit(True).alias("asked"), F.lit(None).cast("double").alias("value"))
    both = rows.unionByName(samples.select("subject", "track", "slot", F.lit(None).cast("string").alias("state"), F.lit(False).alias("asked"), F.col("value").cast("double").alias("value")))
    near = F.when(~F.col("asked") & F.col("value").isNotNull(), F.struct("slot", "value"))
    series = Window.partitionBy("subject", "track").orderBy("slot")
    before = F.last(near, ignorenulls=True).over(series.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(near, ignorenulls=True).over(series.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    held = both.withColumns({"before": before, "after": after}).filter("asked")
    gap_before, gap_after = F.col("before.slot") - F.col("slot"), F.col("after.slot") - F.col("slot")
    return held.select(
        "subject", "track", "slot", "state", F.col("before.value").alias("before_value"), gap_before.alias("before_offset"), lag_class(gap_before).alias("before_class"),
        F.col("after.value").alias("after_value"), gap_after.alias("after_offset"), lag_class(gap_after).alias("after_class"),
    )


def peak_relations(points: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each key point (subject, kind, slot) beside the largest observed sample of each track of its subject, the earliest of equal ones: offset in slots, relation and direction."""
    peaks = tracks.groupBy("subject", "track").agg(F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("value")).alias("less"), "slot"))).alias("x"))
    offset = F.col("x.slot") - F.col("slot")
    met = points.join(peaks, "subject")
    return met.select("subject", "track", "kind", "slot", F.col("x.slot").alias("peak_slot"), (-F.col("x.less")).alias("peak_value"), offset.alias("offset"), lag_class(offset).alias("relation"), direction(offset).alias("direction"))
