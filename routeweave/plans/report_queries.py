"""Queries of report rows, nested records, timelines and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, reports
from . import bindings as B
from .registry import query
from .series_queries import DAILY, FULL, GRID, HOURLY, RUNS, daily, filled, hourly, stated


@query(
    "named_asns",
    f"WITH {B.OUTAGE_SQL} SELECT event_id, coalesce(nullif(CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END, ''), nullif(c_name, ''), '') AS as_name FROM outage LEFT JOIN customer ON c_custkey = asn",
)
def named_asns(spark, sf_dir):
    names = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asn"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("name_local"), F.col("c_name").alias("name_en"))
    rows = B.outages(spark, sf_dir).select("event_id", F.concat(F.col("asn").cast("string"), F.lit("_64512")).alias("asn"))
    return reports.with_attributes(rows, "asn", names).select("event_id", "as_name")


@query(
    "path_observations",
    f"""WITH {B.ROUTE_SQL}, r AS (SELECT prefix_id, strftime(ts, '%Y-%m-%d') AS observed, as_path, row_number() OVER (PARTITION BY prefix_id, strftime(ts, '%Y-%m-%d') ORDER BY as_path) - 1 AS ordinal FROM (SELECT DISTINCT prefix_id, date_trunc('day', ts) AS ts, as_path FROM route WHERE as_path IS NOT NULL))
SELECT prefix_id, observed, ordinal, as_path, sha256('path|' || as_path) AS path_id FROM r""",
)
def path_observations(spark, sf_dir):
    """Each prefix's paths by day as one JSON object, and back."""
    routes = B.route_events(spark, sf_dir).filter("as_path IS NOT NULL").groupBy("prefix_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sort_array(F.collect_set("as_path")).alias("paths"))
    snapshots = routes.groupBy("prefix_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("day", "paths")))).alias("snapshots"))
    return reports.path_observations(snapshots, ["prefix_id"], "snapshots").withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(
    "unnested_items",
    "SELECT o_orderkey AS event_id, CASE WHEN l_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 END AS ordinal, l_partkey AS part, l_quantity::BIGINT AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 10",
)
def unnested_items(spark, sf_dir):
    i = B.read(spark, sf_dir, "lineitem").filter("l_quantity > 10")
    item = F.struct("l_linenumber", F.col("l_partkey").alias("part"), "l_suppkey", F.col("l_quantity").cast("bigint").alias("quantity"))
    lists = i.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("payload"))
    staged = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id")).join(lists, "event_id", "left")
    return reports.unnested(staged, ["event_id"], "payload", "struct<part:bigint,quantity:bigint>").withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(
    "text_filter",
    f"WITH {B.OUTAGE_SQL} SELECT event_id FROM outage WHERE level IN ('high', 'low') AND (contains(lower(country), 'n_1') OR contains(lower(level), 'n_1'))",
)
def text_filter(spark, sf_dir):
    return reports.text_filter(B.outages(spark, sf_dir), ["country", "level"], "N_1", {"level": ["high", "low"]}).select("event_id")


@query(
    "mapped_routes",
    f"""WITH {B.ROUTE_SQL}, r AS (SELECT origin, CASE WHEN origin IS NULL THEN 'unknown' WHEN prefix_id % 7 = 0 THEN 'conflict' ELSE 'resolved' END AS st FROM route)
SELECT n_name AS country, CASE WHEN st <> 'resolved' THEN 'origin_' || st WHEN n_name IS NULL THEN 'unmapped_country' END AS reason, count(*) AS n FROM r LEFT JOIN nation ON 3000 + n_nationkey = origin GROUP BY ALL""",
)
def mapped_routes(spark, sf_dir):
    kind = F.when(F.col("origin").isNull(), "unknown").when(F.col("prefix_id") % 7 == 0, "conflict").otherwise("resolved")
    mapping = B.read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 3000).alias("asn"), F.col("n_name").alias("country"))
    return reports.mapped_routes(B.route_events(spark, sf_dir).withColumn("origin_state", kind), mapping).groupBy("country", "reason").agg(F.count("*").alias("n"))


@query(
    "state_timelines",
    f"WITH {RUNS}, x AS (SELECT asn, run, state, count(*) AS n FROM r GROUP BY asn, run, state) SELECT asn, string_agg(state || '*' || n, ' ' ORDER BY run) AS timeline, count(*) AS n_runs, sum(n)::BIGINT AS n_slots FROM x GROUP BY asn",
)
def state_timelines(spark, sf_dir):
    return reports.state_timelines(stated(spark, sf_dir), ["asn"], "slot", "state")


@query(
    "state_summary",
    f"""WITH {RUNS}, x AS (SELECT asn, run, state, count(*) AS n FROM r GROUP BY asn, run, state)
SELECT asn, coalesce(sum(n) FILTER (state = 'empty'), 0)::BIGINT AS n_empty, coalesce(sum(n) FILTER (state = 'low'), 0)::BIGINT AS n_low, coalesce(max(n) FILTER (state = 'empty'), 0) AS longest_empty, coalesce(max(n) FILTER (state = 'low'), 0) AS longest_low, arg_max(state, run) AS end_state FROM x GROUP BY asn""",
)
def state_summary(spark, sf_dir):
    return reports.state_summary(stated(spark, sf_dir), ["asn"], "slot", "state", ["empty", "low"])


@query(
    "segment_summary",
    f"""WITH {HOURLY}, {GRID}, g2 AS (SELECT g.asn, g.slot, n FROM g LEFT JOIN h USING (asn, slot)), b AS (SELECT asn, min(slot) AS lo, max(slot) AS hi FROM g GROUP BY asn),
s AS (SELECT asn, 'first_half' AS segment, lo AS a, lo + (hi - lo) // 2 AS z FROM b UNION ALL SELECT asn, 'second_half', lo + (hi - lo) // 2, hi FROM b)
SELECT s.asn, segment, min(n) AS lowest, max(n) AS highest, sum(n)::BIGINT AS total, count(n) AS observed, count(*) - count(n) AS missing FROM s JOIN g2 ON s.asn = g2.asn AND slot BETWEEN a AND z GROUP BY ALL""",
)
def segment_summary(spark, sf_dir):
    h = hourly(spark, sf_dir)
    bounds = h.groupBy("asn").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    half = F.col("lo") + F.expr("(hi - lo) div 2")
    segments = bounds.select("asn", F.lit("first_half").alias("segment"), F.col("lo").alias("first_slot"), half.alias("last_slot")).union(bounds.select("asn", F.lit("second_half"), half, "hi"))
    rows = intervals.slot_grid(bounds, ["asn"], "lo", "hi", 3600).join(h, ["asn", "slot"], "left")
    return reports.segment_summary(rows, segments, "asn", "slot", "n")


@query(
    "metric_series",
    f"""WITH d AS (SELECT user_id % 20 AS asn, epoch(date_trunc('day', ts))::BIGINT AS slot, count(*)::DOUBLE AS events, count(DISTINCT user_id)::DOUBLE AS users FROM events GROUP BY ALL),
l AS (SELECT asn, slot, 'events' AS metric, events AS value FROM d UNION ALL SELECT asn, slot, 'users', users FROM d)
SELECT asn, slot, metric, value, value - lag(value) OVER w AS delta, value / first_value(value) OVER w AS share, row_number() OVER (PARTITION BY asn, metric ORDER BY value, slot) = 1 AS is_lowest FROM l WINDOW w AS (PARTITION BY asn, metric ORDER BY slot)""",
)
def metric_series(spark, sf_dir):
    slot = F.unix_timestamp(F.date_trunc("day", "ts"))
    d = B.read(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("asn"), slot.alias("slot")).agg(F.count("*").cast("double").alias("events"), F.count_distinct("user_id").cast("double").alias("users"))
    return reports.metric_series(d, ["asn"], "slot", ["events", "users"])


@query(
    "quarantined",
    f"WITH {B.OUTAGE_SQL} SELECT event_id, concat_ws(',', CASE WHEN asn % 10 = 0 THEN 'identity' END, CASE WHEN end_s IS NULL THEN 'time' END, CASE WHEN end_s - start_s > 8640000 THEN 'window' END) AS reasons FROM outage",
)
def quarantined(spark, sf_dir):
    rules = {"identity": F.col("asn") % 10 == 0, "time": F.col("end_s").isNull(), "window": F.col("end_s") - F.col("start_s") > 8_640_000}
    return reports.quarantined(B.outages(spark, sf_dir), rules).select("event_id", "reasons")


@query(
    "duration_checks",
    f"""WITH {B.OUTAGE_SQL}, c AS (SELECT *, (floor(amount)::BIGINT)::BIGINT % 200 * 86400 AS claimed, end_s - start_s AS taken FROM outage)
SELECT CASE WHEN end_s IS NULL THEN 'open' WHEN taken < 0 THEN 'reversed' WHEN abs(taken - claimed) <= 2592000 THEN 'consistent' ELSE 'inconsistent' END AS duration_check, count(*) AS n FROM c GROUP BY ALL""",
)
def duration_checks(spark, sf_dir):
    rows = B.outages(spark, sf_dir).withColumn("claimed", F.floor("amount") % 200 * 86400)
    return reports.duration_checks(rows, "start_s", "end_s", "claimed", 2_592_000).groupBy("duration_check").agg(F.count("*").alias("n"))


@query(
    "gap_classes",
    f"""WITH {HOURLY}, {GRID}, {FULL}, m AS (SELECT asn, slot FROM f WHERE value_state = 'not_observed'), d AS (SELECT user_id % 20 AS asn, epoch(date_trunc('hour', ts))::BIGINT - 7200 AS a, epoch(date_trunc('hour', ts))::BIGINT AS z FROM events WHERE event_type = 'error')
SELECT asn, slot, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.asn = m.asn AND m.slot >= a AND m.slot < z) THEN 'source_unavailable' ELSE 'processing_gap' END AS grid_class FROM m""",
)
def gap_classes(spark, sf_dir):
    missing = filled(spark, sf_dir).filter("value_state = 'not_observed'").select("asn", "slot")
    hour = F.unix_timestamp(F.date_trunc("hour", "ts"))
    declared = B.read(spark, sf_dir, "events").filter("event_type = 'error'").select((F.col("user_id") % 20).alias("asn"), (hour - 7200).alias("gap_from"), hour.alias("gap_to"))
    return reports.gap_classes(missing, declared, "asn")


@query(
    "closure_checks",
    """WITH c AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN f + o = total THEN 'holds' ELSE 'broken' END AS classes_check, 'holds' AS share_check FROM c""",
)
def closure_checks(spark, sf_dir):
    """Orders of a customer by two of three states: where one is of the third, the classes do not close."""
    state = lambda x: F.count_if(F.col("o_orderstatus") == x)
    c = B.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), state("F").alias("f"), state("O").alias("o")).withColumn("share", (F.col("f") + F.col("o")) / F.col("total"))
    return reports.closure_checks(c, "total", ["f", "o"], {"share": (["f", "o"], "total")}).select("o_custkey", "classes_check", "share_check")


@query("record_ids", "SELECT event_id, sha256(coalesce(event_type, '\\N') || '|' || coalesce(user_id::VARCHAR, '\\N') || '|' || event_id) AS record_id FROM events")
def record_ids(spark, sf_dir):
    return B.read(spark, sf_dir, "events").select("event_id", reports.record_id(F.col("event_type"), F.col("user_id"), F.col("event_id")).alias("record_id"))


@query(
    "covered_blocks_udaf",
    f"WITH {B.ROUTE_SQL} SELECT vp, count(DISTINCT CAST(split_part(prefix, '.', 2) AS BIGINT) * 256 + CAST(split_part(prefix, '.', 3) AS BIGINT)) AS blocks FROM route GROUP BY vp",
)
def covered_blocks_udaf(spark, sf_dir):
    return B.route_events(spark, sf_dir).select("vp", "prefix").distinct().groupBy("vp").agg(reports.covered_blocks("prefix").alias("blocks"))


@query(
    "allocated_asns",
    "WITH c AS (SELECT n_name AS country, count(DISTINCT c_custkey) AS n_asns FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n_asns DESC, country) AS rank FROM c QUALIFY rank <= 10",
)
def allocated_asns(spark, sf_dir):
    c = B.read(spark, sf_dir, "customer").join(B.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.allocated(c.withColumnRenamed("n_name", "country"), "country", "c_custkey", 10)


@query(
    "country_totals",
    f"WITH {DAILY} SELECT asn % 5 AS country, slot, sum(v) AS total, count(*) AS n_asns FROM d GROUP BY ALL",
)
def country_totals(spark, sf_dir):
    """Country series from the rows of their networks."""
    return daily(spark, sf_dir).groupBy((F.col("asn") % 5).alias("country"), "slot").agg(F.sum("v").alias("total"), F.count("*").alias("n_asns"))
