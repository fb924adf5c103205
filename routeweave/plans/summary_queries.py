"""Queries over episode records, country summaries, AS lists, key facts and dimension probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concurrency, coverage, incidents, metrics, summaries
from . import bindings as B
from . import episode_queries as E
from . import impact_queries as I
from .registry import query


@query(
    "episode_as_records",
    f"""WITH RECURSIVE {E.EPISODE_SQL},
e AS (SELECT subject || '/' || ordinal AS episode, substr(subject, 9)::BIGINT AS event, onset_at AS onset, peak_at AS peak, observation_end_at AS last FROM episode),
lost AS (SELECT e.episode, e.event, o.asn, c.prefix, c.slot, e.onset, e.peak, e.last FROM e JOIN classed c ON c.event = e.event AND c.slot BETWEEN e.onset AND e.last JOIN origins o ON o.event = c.event AND o.prefix = c.prefix WHERE c.class = 'completely_interrupted'),
found AS (
  SELECT episode, event, asn, count(DISTINCT prefix) FILTER (slot = onset) AS t, count(DISTINCT prefix) FILTER (slot = peak) AS p, count(DISTINCT prefix) FILTER (slot = last) AS z, count(DISTINCT prefix) AS c, min(slot) AS first_damaged, max(slot) AS last_damaged, any_value(last) AS last FROM lost GROUP BY ALL),
members AS (SELECT event, asn, count(*) AS fixed_prefixes FROM (SELECT DISTINCT event, prefix FROM classed) JOIN origins USING (event, prefix) GROUP BY ALL)
SELECT e.episode, e.event, m.asn, fixed_prefixes, coalesce(t, 0) AS trigger_prefixes, coalesce(p, 0) AS peak_prefixes, coalesce(z, 0) AS end_prefixes, coalesce(c, 0) AS cumulative_prefixes, first_damaged, last_damaged, coalesce(t, 0) > 0 AS trigger_member, coalesce(p, 0) > 0 AS peak_member,
       coalesce(c, 0) > 0 AS cumulative_member, coalesce(z, 0) > 0 AS end_member, CASE WHEN c > 0 AND z = 0 AND last_damaged < f.last THEN last_damaged + 1 END AS recovered_from
FROM e JOIN members m USING (event) LEFT JOIN found f ON f.episode = e.episode AND f.asn = m.asn""",
)
def episode_as_records(spark, sf_dir):
    found = incidents.incident_episodes(E.observations(spark, sf_dir), E.RULES)
    episodes = coverage.stored(found.select(F.concat_ws("/", "subject", "ordinal").alias("episode"), F.substring("subject", 9, 20).cast("bigint").alias("event"), F.col("onset_at").alias("onset"), F.col("peak_at").alias("peak"), F.col("observation_end_at").alias("last")))
    rows, own, _ = I.classed(spark, sf_dir)
    return summaries.episode_as_records(rows, own, episodes)


@query(
    "country_summaries",
    f"""WITH {I.COHORT_SQL},
fixed AS (SELECT c.event, c.slot, sum(expected) AS b, sum(visible) AS v, sum(expected) FILTER (afi = 4) AS b4, sum(visible) FILTER (afi = 4) AS v4, sum(expected) FILTER (afi = 6) AS b6, sum(visible) FILTER (afi = 6) AS v6 FROM classed c JOIN named USING (event, prefix) GROUP BY ALL),
now AS (SELECT h.event, slot, sum(up) AS c, sum(up) FILTER (afi = 4) AS c4, sum(up) FILTER (afi = 6) AS c6 FROM held h JOIN named USING (event, prefix) GROUP BY ALL),
per_as AS (SELECT event, asn, slot, sum(visible) AS v, sum(expected) AS e FROM classed JOIN origins USING (event, prefix) GROUP BY ALL),
ases AS (SELECT event, slot, count(*) FILTER (v > 0) AS a, count(*) FILTER (v < e) AS b, count(*) FILTER (v = 0) AS c FROM per_as GROUP BY ALL)
SELECT event, slot, b::BIGINT AS baseline, coalesce(b4, 0)::BIGINT AS baseline_v4, coalesce(b6, 0)::BIGINT AS baseline_v6, v::BIGINT AS visible, coalesce(v4, 0)::BIGINT AS visible_v4, coalesce(v6, 0)::BIGINT AS visible_v6, n.c::BIGINT AS current, coalesce(c4, 0)::BIGINT AS current_v4, coalesce(c6, 0)::BIGINT AS current_v6,
       a AS visible_asns, s.b AS affected_asns, s.c AS invisible_asns, v / f.b AS visible_ratio FROM (SELECT event, slot, b, b4, b6, v, v4, v6 FROM fixed) f JOIN now n USING (event, slot) JOIN (SELECT event, slot, a, b, c FROM ases) s USING (event, slot)""".replace("b::BIGINT AS baseline,", "f.b::BIGINT AS baseline,"),
)
def country_summaries(spark, sf_dir):
    rows = I.states(spark, sf_dir)
    members, _ = coverage.cohort(rows, I.cohorts(rows))
    return summaries.country_summaries(rows, coverage.stored(members), I.origins(rows), I.cohorts(rows))


OVERVIEW_SQL = f"""{I.COHORT_SQL},
marks AS (SELECT *, slot - row_number() OVER (PARTITION BY event, asn, class ORDER BY slot) AS g FROM asns),
lengths AS (SELECT event, asn, class, count(*) AS n FROM marks GROUP BY event, asn, class, g),
overview AS (
  SELECT event, asn, array_to_string(families, ',') AS families, baseline, coalesce(sum(n) FILTER (class = 'normal'), 0)::BIGINT AS slots_fully_visible, coalesce(max(n) FILTER (class = 'normal'), 0) AS longest_fully_visible, coalesce(sum(n) FILTER (class = 'affected'), 0)::BIGINT AS slots_partially_visible,
         coalesce(max(n) FILTER (class = 'affected'), 0) AS longest_partially_visible, coalesce(sum(n) FILTER (class = 'route_interrupted'), 0)::BIGINT AS slots_fully_invisible, coalesce(max(n) FILTER (class = 'route_interrupted'), 0) AS longest_fully_invisible
  FROM lengths JOIN (SELECT event, asn, list_sort(list(DISTINCT afi)) AS families, sum(expected)::BIGINT AS baseline FROM (SELECT DISTINCT event, prefix, expected FROM classed) JOIN named USING (event, prefix) JOIN origins USING (event, prefix) GROUP BY ALL) USING (event, asn) GROUP BY ALL)"""


def overview(spark, sf_dir):
    return summaries.asn_overview(*I.classed(spark, sf_dir))


def in_text(rows):
    return rows.withColumn("families", F.array_join(F.col("families").cast("array<string>"), ","))


@query("asn_overview", f"WITH {OVERVIEW_SQL} SELECT * FROM overview")
def asn_overview(spark, sf_dir):
    return in_text(overview(spark, sf_dir))


@query(
    "asn_page",
    f"""WITH {OVERVIEW_SQL}, kept AS (SELECT * FROM overview WHERE contains(families, '4') AND slots_partially_visible > 0 AND contains(asn::VARCHAR, '30')),
placed AS (SELECT *, row_number() OVER (ORDER BY longest_partially_visible DESC, slots_partially_visible DESC, asn, event) AS position FROM kept)
SELECT p.*, total, least(2, pages) AS page, pages FROM placed p, (SELECT count(*) AS total, greatest(1, ceil(count(*) / 7))::INT AS pages FROM kept) WHERE (position - 1) // 7 + 1 = least(2, pages)""",
)
def asn_page(spark, sf_dir):
    rows = summaries.filter_ases(overview(spark, sf_dir), "AS30", "ipv4", "partial")
    return in_text(summaries.page(rows, [*summaries.as_order("partial"), F.asc("event")], 2, 7))


@query(
    "downstream_page",
    f"""WITH pairs AS ({{concurrent}}), kept AS (SELECT * FROM pairs WHERE slots > 0), placed AS (SELECT *, row_number() OVER (ORDER BY slots DESC, affected, downstream, event) AS position FROM kept)
SELECT *, (SELECT count(*) FROM kept) AS total, 1 AS page, ceil((SELECT count(*) FROM kept) / 20)::INT AS pages FROM placed WHERE position <= 20""".replace("{concurrent}", I.query_sql("concurrent_losses")),
)
def downstream_page(spark, sf_dir):
    rows, own, ends = I.classed(spark, sf_dir)
    related = own.select("event", F.expr("3000 + (prefix div 3) % 20").alias("affected"), F.col("asn").alias("downstream"), "prefix").filter("affected <> downstream")
    pairs = coverage.stored(summaries.downstream_rows(concurrency.concurrent_losses(rows, related, own, ends), scope="concurrent"))
    return summaries.page(pairs, [F.desc("slots"), F.asc("affected"), F.asc("downstream"), F.asc("event")], 1, 20)


@query(
    "key_facts",
    f"""WITH {I.COHORT_SQL},
v AS (SELECT event AS subject, slot, CASE WHEN slot % 29 <> 7 THEN sum(visible)::BIGINT END AS value FROM classed GROUP BY event, slot),
a AS (SELECT event AS subject, slot, count(*) FILTER (class = 'affected') AS affected, count(*) FILTER (class = 'route_interrupted') AS interrupted FROM asns GROUP BY ALL),
s AS (SELECT *, value - lag(value) OVER (PARTITION BY subject ORDER BY slot) AS step FROM v JOIN a USING (subject, slot) WHERE value IS NOT NULL),
f AS (
  SELECT subject, min(slot) AS start_slot, arg_min(value, slot) AS start_value, max(slot) AS end_slot, arg_max(value, slot) AS end_value, arg_min(slot, (value, slot)) AS lowest_slot, min(value) AS lowest_value, arg_min(slot, (step, slot)) FILTER (step < 0) AS drop_slot, -min(step) FILTER (step < 0) AS largest_drop,
         max(affected) AS affected_peak, arg_min(slot, (-affected, slot)) AS affected_peak_slot, max(interrupted) AS interrupted_peak, arg_min(slot, (-interrupted, slot)) AS interrupted_peak_slot FROM s GROUP BY subject)
SELECT subject, start_slot, start_value, end_slot, end_value, lowest_slot, lowest_value, drop_slot, largest_drop, start_value - lowest_value AS lost, (start_value - lowest_value) / start_value AS lost_ratio, end_value - lowest_value AS recovered,
       CASE WHEN start_value > lowest_value THEN (end_value - lowest_value) / (start_value - lowest_value) END AS recovered_share, start_value - end_value AS end_gap, affected_peak, affected_peak_slot, interrupted_peak, interrupted_peak_slot FROM f""",
)
def key_facts(spark, sf_dir):
    rows = I.states(spark, sf_dir)
    s = coverage.event_series(rows, I.cohorts(rows), I.origins(rows))
    series = s.select(F.col("event").alias("subject"), "slot", F.when(F.col("slot") % 29 != 7, F.col("prefix_visible_directions")).alias("value"), F.col("asn_affected").alias("affected"), F.col("asn_interrupted").alias("interrupted"))
    return summaries.key_facts(coverage.stored(series), ["affected", "interrupted"])


@query(
    "incident_mappings",
    """WITH i AS (SELECT DISTINCT o_custkey AS incident FROM orders), m AS (SELECT o_custkey AS incident, o_orderkey AS episode, CASE WHEN o_orderpriority LIKE '1%' THEN 'overlaps' WHEN o_orderpriority LIKE '2%' THEN 'contains' ELSE 'no_correspondence' END AS relation, o_orderstatus = 'P' AS causal FROM orders WHERE o_totalprice > 250000)
SELECT i.incident, coalesce(array_to_string(list_sort(list(DISTINCT episode) FILTER (episode IS NOT NULL)), ','), '') AS episodes, coalesce(array_to_string(list_sort(list(DISTINCT relation) FILTER (relation IS NOT NULL)), ','), 'no_correspondence') AS relation
FROM i LEFT JOIN (SELECT * FROM m WHERE relation <> 'no_correspondence' AND NOT causal) x USING (incident) GROUP BY i.incident""",
)
def incident_mappings(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders")
    relation = F.when(F.col("o_orderpriority").startswith("1"), "overlaps").when(F.col("o_orderpriority").startswith("2"), "contains").otherwise("no_correspondence")
    mappings = o.filter("o_totalprice > 250000").select(F.col("o_custkey").alias("incident"), F.col("o_orderkey").alias("episode"), relation.alias("relation"), (F.col("o_orderstatus") == "P").alias("causal"))
    found = summaries.incident_mappings(o.select(F.col("o_custkey").alias("incident")), mappings)
    return found.withColumn("episodes", F.array_join(F.col("episodes").cast("array<string>"), ","))


@query(
    "dimension_probe",
    """WITH t AS (
  SELECT CASE WHEN l_orderkey % 50 = 3 THEN '' WHEN l_orderkey % 50 = 4 THEN 'x' || l_suppkey ELSE 'AS' || l_suppkey END AS k, CASE WHEN l_linenumber = 2 THEN '[1, 2' WHEN l_linenumber = 3 THEN NULL ELSE '[' || l_partkey || ', ''y' || l_suppkey || ''']' END AS v, l_linenumber FROM lineitem),
m AS (SELECT k, k = '' AS empty, k LIKE 'x%' AS invalid, l_linenumber FROM t)
SELECT count(*) AS "rows", count(DISTINCT k) FILTER (NOT empty AND NOT invalid) AS valid_keys, count(*) FILTER (empty) AS empty_keys, count(*) FILTER (invalid) AS invalid_keys, count(*) FILTER (NOT empty AND NOT invalid) - count(DISTINCT k) FILTER (NOT empty AND NOT invalid) AS repeated_keys,
       count(*) FILTER (NOT empty AND NOT invalid AND l_linenumber = 2) AS unsafe_lists, count(*) FILTER (NOT empty AND NOT invalid AND l_linenumber NOT IN (2, 3)) AS bad_targets FROM m""",
)
def dimension_probe(spark, sf_dir):
    from ..functions.scalars import normalize_asn

    i = B.read(spark, sf_dir, "lineitem")
    key = F.when(F.col("l_orderkey") % 50 == 3, "").when(F.col("l_orderkey") % 50 == 4, F.concat(F.lit("x"), "l_suppkey")).otherwise(F.concat(F.lit("AS"), "l_suppkey"))
    value = F.when(F.col("l_linenumber") == 2, "[1, 2").when(F.col("l_linenumber") != 3, F.concat(F.lit("["), "l_partkey", F.lit(", 'y"), "l_suppkey", F.lit("']")))
    rows = i.select(key.alias("k"), value.alias("v"))
    return summaries.probe_table(rows, F.col("k"), normalize_asn(F.col("k")).isNotNull(), ["v"], ["v"])


@query(
    "outage_places",
    f"""WITH {B.OUTAGE_SQL} SELECT country, level, count(*) AS n, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 2.5 - 30 END AS lat, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 7.5 - 90 END AS lon FROM outage LEFT JOIN nation ON n_name = country GROUP BY country, level, n_nationkey""",
)
def outage_places(spark, sf_dir):
    n = F.col("n_nationkey")
    places = B.read(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_name").alias("country"), (n * 2.5 - 30).alias("lat"), (n * 7.5 - 90).alias("lon"))
    return summaries.with_coordinates(B.outages(spark, sf_dir).groupBy("country", "level").agg(F.count("*").alias("n")), places, "country")


@query(
    "country_samples",
    f"""WITH {I.COHORT_SQL},
v AS (SELECT event, slot, sum(visible)::BIGINT AS visible FROM classed WHERE slot % 3 <> 0 GROUP BY ALL), a AS (SELECT event, slot, count(*) FILTER (class <> 'normal') AS hit FROM asns WHERE slot % 4 <> 1 GROUP BY ALL),
u AS (SELECT event, slot, count(*) AS updates FROM (SELECT (epoch_s - {I.FIRST_S}) // {I.SLOT_S} AS slot, prefix_id AS prefix FROM route) JOIN named USING (prefix) GROUP BY ALL)
SELECT event, slot, visible, hit, updates, concat_ws(',', CASE WHEN visible IS NOT NULL THEN 'visible' END, CASE WHEN hit IS NOT NULL THEN 'hit' END, CASE WHEN updates IS NOT NULL THEN 'updates' END) AS measures FROM v FULL JOIN a USING (event, slot) FULL JOIN u USING (event, slot)""",
)
def country_samples(spark, sf_dir):
    rows = I.states(spark, sf_dir)
    s = coverage.stored(coverage.event_series(rows, I.cohorts(rows), I.origins(rows)))
    events = I.prefixes(B.route_events(spark, sf_dir).withColumn("slot", F.expr(f"(epoch_s - {I.FIRST_S}) div {I.SLOT_S}"))).groupBy("event", "slot").agg(F.count("*").alias("updates"))
    visible = s.filter("slot % 3 <> 0").select("event", "slot", F.col("prefix_visible_directions").alias("visible"))
    hit = s.filter("slot % 4 <> 1").select("event", "slot", (F.col("asn_affected") + F.col("asn_interrupted")).alias("hit"))
    return metrics.country_samples([visible, hit, events], ["event", "slot"]).withColumn("measures", F.array_join("measures", ","))
