"""Queries over metric series and records with outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, series
from . import bindings as B
from .registry import query

STEP = 3600


def updates(spark, sf_dir):
    """(subject, slot, announces, withdraws): hours of each network."""
    slot = F.unix_timestamp(F.date_trunc("hour", "ts"))
    e = B.read(spark, sf_dir, "events").withColumns({"subject": F.col("user_id") % 20, "slot": slot})
    return e.groupBy("subject", "slot").agg(F.count_if(F.col("event_type") != "error").alias("announces"), F.count_if(F.col("event_type") == "error").alias("withdraws"))


def expected_slots(rows):
    """All hours between the first and the last of any network, with a class."""
    bounds = rows.groupBy().agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    grid = bounds.select(F.explode(F.sequence("low", "high", F.lit(STEP))).alias("slot"))
    h = F.col("slot") / STEP
    kind = F.when(h % 37 == 5, "parse_failed").when(h % 41 == 7, "processing_gap").when(h % 47 == 11, "legacy_unknown").when(h % 43 != 9, "available")
    return rows.select("subject").distinct().withColumn("k", F.lit(1)).join(grid.withColumn("k", F.lit(1)), "k").select("subject", "slot", kind.alias("class"))


METRIC_SQL = f"""
u AS (SELECT user_id % 20 AS subject, epoch(date_trunc('hour', ts))::BIGINT AS slot, count(*) FILTER (event_type <> 'error') AS a, count(*) FILTER (event_type = 'error') AS w FROM events GROUP BY ALL),
hours AS (SELECT unnest(range(min(slot), max(slot) + 1, {STEP})) AS slot FROM u),
slots AS (SELECT subject, slot, CASE WHEN slot // 3600 % 37 = 5 THEN 'parse_failed' WHEN slot // 3600 % 41 = 7 THEN 'processing_gap' WHEN slot // 3600 % 47 = 11 THEN 'legacy_unknown' WHEN slot // 3600 % 43 <> 9 THEN 'available' END AS class FROM (SELECT DISTINCT subject FROM u), hours),
j AS (SELECT s.*, u.a, u.w, u.subject IS NOT NULL AS here FROM slots s LEFT JOIN u USING (subject, slot)),
ratio AS (
  SELECT subject, slot, CASE WHEN class = 'available' AND a + w > 0 THEN w / (a + w) END AS value, CASE WHEN class IS NULL THEN 'source_unavailable' WHEN class <> 'available' THEN class WHEN here AND a + w = 0 THEN 'not_applicable' WHEN NOT here THEN 'row_missing' WHEN w = 0 THEN 'observed_zero' ELSE 'observed_nonzero' END AS value_state,
         CASE WHEN class = 'available' AND here THEN w END AS numerator, CASE WHEN class = 'available' AND here THEN a + w END AS denominator, coalesce(class = 'available' AND here, false) AS active FROM j),
total AS (
  SELECT subject, slot, CASE WHEN class = 'available' THEN coalesce(a + w, 0)::DOUBLE END AS value, CASE WHEN class IS NULL THEN 'source_unavailable' WHEN class <> 'available' THEN class WHEN coalesce(a + w, 0) = 0 THEN 'observed_zero' ELSE 'observed_nonzero' END AS value_state,
         NULL::BIGINT AS numerator, NULL::BIGINT AS denominator, coalesce(class = 'available' AND here, false) AS active FROM j)"""


def _reason(table: str) -> str:
    return f"SELECT subject, slot, value, value_state, CASE WHEN value_state = 'not_applicable' THEN 'denominator_zero' WHEN value_state NOT LIKE 'observed%' THEN value_state END AS missing_reason, numerator, denominator, active FROM {table}"


def points(spark, sf_dir, kind, sparse=False):
    rows = updates(spark, sf_dir)
    return metrics.metric_points(rows, expected_slots(rows), kind, sparse)


@query("withdraw_ratio_points", f"WITH {METRIC_SQL} {_reason('ratio')}")
def withdraw_ratio_points(spark, sf_dir):
    return points(spark, sf_dir, "withdraw_ratio")


@query("update_total_points", f"WITH {METRIC_SQL} {_reason('total')}")
def update_total_points(spark, sf_dir):
    return points(spark, sf_dir, "update_total", True)


@query(
    "metric_coverage",
    f"""WITH {METRIC_SQL}, s AS (
  SELECT subject, count(*) AS expected, count(*) FILTER (value_state NOT IN ('source_unavailable', 'parse_failed')) AS source_observed, count(*) FILTER (value_state LIKE 'observed%') AS metric_observed, count(*) FILTER (active) AS active,
         count(*) FILTER (value_state = 'processing_gap') AS processing_gaps FROM total GROUP BY subject)
SELECT *, round(source_observed / expected, 10) AS source_ratio, round(metric_observed / expected, 10) AS metric_ratio, round(active / source_observed, 10) AS density, expected - source_observed AS source_gaps FROM s""",
)
def metric_coverage(spark, sf_dir):
    return metrics.metric_coverage(points(spark, sf_dir, "update_total", True))


@query(
    "metric_checks",
    f"""WITH {METRIC_SQL},
told AS (
  SELECT subject, slot, CASE WHEN value_state = 'processing_gap' AND subject % 3 = 0 THEN 0 WHEN slot // 3600 % 101 = 3 AND value IS NOT NULL THEN value + 1 ELSE value END AS value, value_state FROM total WHERE NOT (subject % 4 = 1 AND slot // 3600 % 59 = 2)),
alone AS (SELECT *, slot - lag(slot) OVER (PARTITION BY subject ORDER BY slot) <> {STEP} AS gap, value_state LIKE 'observed%' AS seen FROM told),
one AS (SELECT subject, count(*) FILTER (gap) AS gaps, count(*) FILTER ((seen <> (value IS NOT NULL)) OR (seen AND (value = 0) <> (value_state = 'observed_zero'))) AS states FROM alone GROUP BY subject),
met AS (
  SELECT coalesce(a.subject, b.subject) AS subject, count(*) FILTER (a.value = 0 AND b.value IS NULL) AS filled, count(*) FILTER (a.value_state IS DISTINCT FROM b.value_state OR a.value IS DISTINCT FROM b.value) AS differ, count(*) FILTER (a.subject IS NULL OR b.subject IS NULL) AS unmet
  FROM told a FULL JOIN total b ON a.subject = b.subject AND a.slot = b.slot GROUP BY ALL)
SELECT subject, unnest(['slot_closure', 'formula', 'missing_state', 'no_zero_fill', 'source_points']) AS "check", unnest([gaps + unmet, 0, states, filled, differ]) AS violations FROM met JOIN one USING (subject)""",
)
def metric_checks(spark, sf_dir):
    """A series with lost slots, zeros put into gaps and wrong values against the source."""
    true = points(spark, sf_dir, "update_total", True)
    h = F.col("slot") / STEP
    value = F.when((F.col("value_state") == "processing_gap") & (F.col("subject") % 3 == 0), 0.0).when((h % 101 == 3) & F.col("value").isNotNull(), F.col("value") + 1).otherwise(F.col("value"))
    told = true.filter(~((F.col("subject") % 4 == 1) & (h % 59 == 2))).withColumn("value", value)
    return metrics.metric_checks(told, true, STEP)


def _kept(item: str) -> str:
    """Of the normal records that are held, one count."""
    return f"list_transform(kept, lambda x: x.{item})"


def _band(item: str, side: str) -> str:
    """The basis of a count, and its band if there are enough."""
    basis = f"CASE WHEN len(kept) > 5 THEN {_kept(item)} WHEN r.i < 7 THEN list_append({_kept(item)}, r.{item}) ELSE []::DOUBLE[] END"
    moved = f"len({basis}) > 0 AND len({basis}) >= n_{item}"
    if side == "n":
        return f"CASE WHEN {moved} THEN len({basis}) ELSE n_{item} END"
    sign, factor = ("+", 1.2) if side == "high" else ("-", 0.8)
    return f"CASE WHEN {moved} THEN trunc((list_avg({basis}) {sign} 3 * list_stddev_pop({basis})) * {factor})::BIGINT ELSE {side}_{item} END"


@query(
    "outlier_records",
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY slot) AS i FROM (
  SELECT user_id % 20 AS subject, epoch(date_trunc('hour', ts))::BIGINT // 21600 * 21600 AS slot, count(*)::DOUBLE AS updates, count(DISTINCT user_id)::DOUBLE AS prefixes FROM events GROUP BY ALL)),
s AS (
  SELECT DISTINCT subject, 0::BIGINT AS i, NULL::BIGINT AS slot, NULL::DOUBLE AS updates, NULL::DOUBLE AS prefixes, []::STRUCT(t BIGINT, updates DOUBLE, prefixes DOUBLE)[] AS kept, NULL::BIGINT AS low_updates, NULL::BIGINT AS high_updates, 0::BIGINT AS n_updates, NULL::BIGINT AS low_prefixes, NULL::BIGINT AS high_prefixes, 0::BIGINT AS n_prefixes, false AS outlier FROM r
  UNION ALL
  SELECT subject, i, slot, updates, prefixes, list_filter(CASE WHEN out THEN kept ELSE list_append(kept, {{'t': slot, 'updates': updates, 'prefixes': prefixes}}) END, lambda x: x.t >= slot - 259200), low_updates, high_updates, n_updates, low_prefixes, high_prefixes, n_prefixes, out
  FROM (SELECT *, coalesce(updates NOT BETWEEN low_updates AND high_updates, false) OR coalesce(prefixes NOT BETWEEN low_prefixes AND high_prefixes, false) AS out FROM (
    SELECT r.subject, r.i, r.slot, r.updates, r.prefixes, kept, {_band("updates", "low")} AS low_updates, {_band("updates", "high")} AS high_updates, {_band("updates", "n")} AS n_updates, {_band("prefixes", "low")} AS low_prefixes, {_band("prefixes", "high")} AS high_prefixes, {_band("prefixes", "n")} AS n_prefixes
    FROM s JOIN r ON r.subject = s.subject AND r.i = s.i + 1)))
SELECT subject, slot, updates, prefixes, low_updates, high_updates, low_prefixes, high_prefixes, outlier FROM s WHERE i > 0""",
)
def outlier_records(spark, sf_dir):
    slot = F.expr("unix_timestamp(date_trunc('hour', ts)) div 21600 * 21600")
    rows = B.read(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("subject"), slot.alias("slot")).agg(F.count("*").cast("double").alias("updates"), F.count_distinct("user_id").cast("double").alias("prefixes"))
    return series.outlier_records(rows, ["subject"], "slot", ["updates", "prefixes"])
