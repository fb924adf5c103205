"""Queries over episodes: incidents with their milestones, what was announced in them, activity beside states, peer sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, evidence, incidents, sessions
from . import bindings as B
from . import impact_queries as I
from .registry import query

RULES = incidents.Rules(damaged=0.6, recovered=0.8, recovery_slots=3, asn_band=(0.95, 1.0), prefix_band=(0.8, 1.0))


def observations(spark, sf_dir):
    """(subject, observed_at, ...): the series of each country's population, with a gap now and then."""
    rows = I.states(spark, sf_dir)
    s = coverage.event_series(rows, I.cohorts(rows), I.origins(rows))
    total = F.col("asn_normal") + F.col("asn_affected") + F.col("asn_interrupted")
    known = F.col("slot") % 29 != 7
    return coverage.stored(s.select(
        F.concat(F.lit("country "), "event").alias("subject"), F.col("slot").alias("observed_at"), F.when(known, "continuous").otherwise("unknown_after_gap").alias("continuity_state"),
        F.when(known, (F.col("asn_affected") + F.col("asn_interrupted")) / total).alias("affected_asn_ratio"), F.when(known, 1 - F.col("asn_interrupted") / total).alias("visible_origin_asn_ratio"),
        F.when(known, F.col("prefix_visible_directions") / F.col("prefix_expected_directions")).alias("visible_prefix_vp_ratio"),
    ))


EPISODE_SQL = I.COHORT_SQL + f""",
shares AS (SELECT event, slot, sum(visible) / sum(expected) AS v FROM classed GROUP BY ALL),
hits AS (SELECT event, slot, count(*) FILTER (class <> 'normal') / count(*) AS a, 1 - count(*) FILTER (class = 'route_interrupted') / count(*) AS o FROM asns GROUP BY ALL),
seen AS (
  SELECT 'country ' || event AS subject, slot, row_number() OVER (PARTITION BY event ORDER BY slot) - 1 AS i, CASE WHEN slot % 29 <> 7 THEN a END AS a, CASE WHEN slot % 29 <> 7 THEN o END AS o, CASE WHEN slot % 29 <> 7 THEN v END AS v
  FROM shares JOIN hits USING (event, slot)),
runs AS (
  SELECT *, sum((a > {RULES.damaged})::INT) OVER (PARTITION BY subject ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) = 2 AS onset,
         sum((o >= {RULES.recovered} AND v >= {RULES.recovered})::INT) OVER (PARTITION BY subject ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS partial,
         sum((o BETWEEN 0.95 AND 1 AND v BETWEEN 0.8 AND 1)::INT) OVER (PARTITION BY subject ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS whole FROM seen),
nexts AS (
  SELECT *, min(CASE WHEN onset THEN i END) OVER w AS next_onset, min(CASE WHEN partial THEN i END) OVER w AS next_partial, min(CASE WHEN whole THEN i END) OVER w AS next_whole
  FROM runs WINDOW w AS (PARTITION BY subject ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ep AS (
  SELECT subject, 1 AS ordinal, next_onset AS s FROM nexts WHERE i = 0 AND next_onset IS NOT NULL
  UNION ALL
  SELECT ep.subject, ordinal + 1, c.next_onset FROM ep JOIN nexts b ON b.subject = ep.subject AND b.i = ep.s JOIN nexts c ON c.subject = ep.subject AND c.i = b.next_whole + 3 WHERE c.next_onset IS NOT NULL),
spans AS (
  SELECT ep.subject, ep.ordinal, s, n.next_whole AS f, CASE WHEN n.next_partial <= coalesce(n.next_whole, n.next_partial) THEN n.next_partial END AS p, coalesce(n.next_whole + 2, (SELECT max(i) FROM seen x WHERE x.subject = ep.subject)) AS e
  FROM ep JOIN nexts n ON n.subject = ep.subject AND n.i = ep.s),
inside AS (
  SELECT p.subject, p.ordinal, p.s, p.f, p.p, p.e, arg_min(n.slot, struct_pack(x := -coalesce(n.a, -1), y := n.i)) AS peak_at, max(n.a) AS peak_value, arg_min(n.slot, struct_pack(x := coalesce(n.v, 2), y := n.i)) AS trough_at, min(n.v) AS trough_value,
         bool_or(n.v IS NULL OR n.o IS NULL) AS missing, arg_min(greatest(n.a, 1 - n.v), struct_pack(x := coalesce(n.v, 2), y := n.i)) AS trough_severity, max(CASE WHEN n.i = p.e THEN greatest(n.a, 1 - n.v) END) AS last_severity
  FROM spans p JOIN nexts n ON n.subject = p.subject AND n.i BETWEEN p.s AND p.e GROUP BY ALL),
episode AS (
  SELECT subject, ordinal::INT AS ordinal, os.slot AS onset_at, CASE WHEN s = 0 THEN 'left_censored_at_window_start' ELSE 'five_minute_state' END AS onset_precision, peak_at, peak_value, trough_at, trough_value, ps.slot AS partial_recovery_at, fs.slot AS full_recovery_at,
         es.slot AS observation_end_at, CASE WHEN f IS NOT NULL THEN 'exact' WHEN s = 0 THEN 'interval' ELSE 'lower_bound' END AS duration_state, coalesce(fs.slot, es.slot) - os.slot AS duration_seconds,
         CASE WHEN f IS NOT NULL THEN 'fully_recovered' WHEN missing THEN 'unknown' WHEN p IS NOT NULL THEN 'partially_recovered' WHEN last_severity < trough_severity THEN 'recovering' ELSE 'ongoing' END AS recovery_state
  FROM inside JOIN seen os USING (subject) JOIN seen es USING (subject) LEFT JOIN seen ps ON ps.subject = inside.subject AND ps.i = p LEFT JOIN seen fs ON fs.subject = inside.subject AND fs.i = f WHERE os.i = s AND es.i = e)"""


@query("incident_episodes", f"WITH RECURSIVE {EPISODE_SQL} SELECT * FROM episode")
def incident_episodes(spark, sf_dir):
    return incidents.incident_episodes(observations(spark, sf_dir), RULES)


@query(
    "incidents",
    f"""WITH RECURSIVE {EPISODE_SQL}
SELECT x.subject, count(e.ordinal) AS episodes, min(onset_at) AS onset_at, arg_min(peak_at, struct_pack(x := -coalesce(peak_value, -1), y := peak_at)) AS peak_at, arg_min(trough_at, struct_pack(x := coalesce(trough_value, 2), y := trough_at)) AS trough_at,
       (array_agg(partial_recovery_at ORDER BY ordinal DESC))[1] AS partial_recovery_at, (array_agg(full_recovery_at ORDER BY ordinal DESC))[1] AS full_recovery_at, x.last AS observation_end_at,
       CASE WHEN bool_or(duration_state = 'lower_bound') THEN 'lower_bound' WHEN bool_or(duration_state = 'interval') THEN 'interval' WHEN count(ordinal) > 0 THEN 'exact' ELSE 'unknown' END AS duration_state,
       coalesce(arg_max(recovery_state, ordinal), 'unknown') AS recovery_state
FROM (SELECT subject, max(slot) AS last FROM seen GROUP BY subject) x LEFT JOIN episode e ON e.subject = x.subject GROUP BY x.subject, x.last""",
)
def incidents_of(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return incidents.incidents(rows, incidents.incident_episodes(rows, RULES))


DAY = 86400
#: Episodes of each country in days from the first: (number, first day, days; the last one is open).
EPISODES = ((0, 2, 3), (1, 9, 2), (2, 17, 4), (3, 26, None))


def changes(spark, sf_dir):
    """(route_event_id, at, family, action, prefix, origin_state, origins)."""
    r = B.route_events(spark, sf_dir)
    state = F.when(F.col("event_id") % 17 == 0, "conflict").when(F.col("event_id") % 19 == 0, "unknown").when(F.col("origin").isNotNull(), "resolved")
    origins = F.when(state == "conflict", F.array("origin", F.lit(7).cast("bigint"))).when(state == "resolved", F.array(F.col("origin").cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    family = F.when(F.col("event_id") % 23 == 0, "ipv4_multicast").when(F.col("prefix_id") % 4 == 3, "ipv6_unicast").otherwise("ipv4_unicast")
    return r.select(F.col("event_id").alias("route_event_id"), F.col("epoch_s").alias("at"), family.alias("family"), F.when(F.col("event_id") % 29 == 0, "rib_snapshot").otherwise(F.col("action")).alias("action"), F.col("prefix_id").alias("prefix"), state.alias("origin_state"), origins.alias("origins"))


def attribution(spark, sf_dir):
    rows = changes(spark, sf_dir)
    resolved = rows.filter(f"at < {I.FIRST_S} + 10 * {DAY} AND origin_state = 'resolved' AND prefix % 5 <> 0 AND action = 'announce'")
    members = resolved.select((F.col("prefix") % 3).alias("cohort"), "family", "prefix", F.get("origins", 0).alias("asn")).union(resolved.filter("prefix % 6 = 1").select(F.lit(9).cast("bigint"), "family", "prefix", F.get("origins", 0))).distinct()
    spans = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(I.FIRST_S + a * DAY).cast("bigint").alias("onset_at"), F.lit(None if n is None else I.FIRST_S + (a + n) * DAY).cast("bigint").alias("end_at")) for k, a, n in EPISODES])
    episodes = members.select("cohort").distinct().select("cohort", F.explode(spans).alias("x")).select((F.col("cohort") * 10 + F.col("x.k")).alias("episode"), "cohort", (F.col("x.onset_at") + F.col("cohort") * 3600).alias("onset_at"), "x.end_at")
    return evidence.attribute_changes(rows, episodes, members)


ATTRIBUTION_SQL = f"""{B.ROUTE_SQL},
change AS (
  SELECT event_id AS route_event_id, epoch_s AS "at", CASE WHEN event_id % 23 = 0 THEN 'ipv4_multicast' WHEN prefix_id % 4 = 3 THEN 'ipv6_unicast' ELSE 'ipv4_unicast' END AS family,
         CASE WHEN event_id % 29 = 0 THEN 'rib_snapshot' ELSE action END AS action, prefix_id AS prefix, origin,
         CASE WHEN event_id % 17 = 0 THEN 'conflict' WHEN event_id % 19 = 0 THEN 'unknown' WHEN origin IS NOT NULL THEN 'resolved' END AS origin_state FROM route),
resolved AS (SELECT * FROM change WHERE "at" < {I.FIRST_S} + 10 * {DAY} AND origin_state = 'resolved' AND prefix % 5 <> 0 AND action = 'announce'),
member AS (SELECT prefix % 3 AS cohort, family, prefix, origin AS asn FROM resolved UNION SELECT 9, family, prefix, origin FROM resolved WHERE prefix % 6 = 1),
held AS (SELECT cohort, family, prefix, list(DISTINCT asn) AS asns FROM member GROUP BY ALL),
episode AS (
  SELECT cohort * 10 + k AS episode, cohort, onset_at + cohort * 3600 AS onset_at, coalesce(end_at, 4000000000000) AS end_at FROM (SELECT DISTINCT cohort FROM held),
  (VALUES {", ".join(f"({k}, {I.FIRST_S + a * DAY}, {'NULL' if n is None else I.FIRST_S + (a + n) * DAY})" for k, a, n in EPISODES)}) v(k, onset_at, end_at)),
met AS (
  SELECT c.*, h.cohort, h.asns, e.episode FROM change c LEFT JOIN held h ON c.action IN ('announce', 'withdraw') AND c.family IN ('ipv4_unicast', 'ipv6_unicast') AND h.family = c.family AND h.prefix = c.prefix
  LEFT JOIN episode e ON e.cohort = h.cohort AND c."at" >= e.onset_at AND c."at" < e.end_at),
told AS (
  SELECT *, CASE WHEN action NOT IN ('announce', 'withdraw') THEN 'other_action' WHEN family NOT IN ('ipv4_unicast', 'ipv6_unicast') THEN 'other_family' WHEN cohort IS NULL THEN 'prefix_not_in_cohort' WHEN episode IS NULL THEN 'outside_episodes'
    WHEN action = 'withdraw' THEN 'withdraw_origin_unavailable' WHEN origin_state = 'conflict' THEN 'origin_conflict' WHEN coalesce(origin_state, '') <> 'resolved' THEN 'origin_unknown'
    WHEN list_contains(asns, origin) THEN 'attributed' ELSE 'resolved_origin_not_in_cohort' END AS outcome FROM met),
attributed AS (
  SELECT route_event_id, cohort, episode, outcome, CASE WHEN outcome = 'attributed' THEN origin END AS asn,
         CASE WHEN outcome IN ('withdraw_origin_unavailable', 'origin_conflict', 'origin_unknown') THEN len(asns) WHEN outcome IN ('attributed', 'resolved_origin_not_in_cohort') THEN 1 ELSE 0 END AS candidates FROM told)"""


@query("attributed_changes", f"WITH {ATTRIBUTION_SQL} SELECT * FROM attributed")
def attributed_changes(spark, sf_dir):
    return attribution(spark, sf_dir)


@query("attribution_counts", f"WITH {ATTRIBUTION_SQL} SELECT episode, outcome, count(*) AS changes, sum(candidates)::BIGINT AS candidates FROM attributed GROUP BY ALL")
def attribution_counts(spark, sf_dir):
    return evidence.attribution_counts(attribution(spark, sf_dir))


def tracks(spark, sf_dir):
    """States of a prefix block by day, and two tracks of its activity by hour of the day."""
    r = B.route_events(spark, sf_dir).withColumns({"subject": F.expr("prefix_id div 10"), "slot": F.expr(f"(epoch_s - {I.FIRST_S}) div 10800")})
    states = r.groupBy("subject", "slot").agg(F.max(F.when(F.col("action") == "withdraw", "impaired").otherwise("normal")).alias("state"))
    samples = r.groupBy("subject", F.when(F.col("vp") % 2 == 0, "announces").otherwise("withdraws").alias("track"), "slot").agg(F.count_if((F.col("action") == "announce") == (F.col("vp") % 2 == 0)).cast("double").alias("value"))
    return states, samples.withColumn("value", F.when((F.col("slot") + F.col("subject")) % 5 != 0, F.col("value")))


TRACK_SQL = f"""{B.ROUTE_SQL},
r AS (SELECT *, prefix_id // 10 AS subject, (epoch_s - {I.FIRST_S}) // 10800 AS s FROM route),
state AS (SELECT subject, s AS slot, max(CASE WHEN action = 'withdraw' THEN 'impaired' ELSE 'normal' END) AS state FROM r GROUP BY ALL),
sample AS (
  SELECT subject, CASE WHEN (vp % 2 = 0) THEN 'announces' ELSE 'withdraws' END AS track, s AS slot, CASE WHEN (s + subject) % 5 <> 0 THEN (count(*) FILTER ((action = 'announce') = (vp % 2 = 0)))::DOUBLE END AS value
  FROM r GROUP BY subject, vp % 2 = 0, s)"""


def _class(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'unavailable' WHEN {c} = 0 THEN 'same_slot' WHEN abs({c}) = 1 THEN 'adjacent_slot' ELSE 'lagged_slot' END"


@query(
    "aligned_tracks",
    f"""WITH {TRACK_SQL},
named AS (SELECT DISTINCT subject, track FROM sample), seen AS (SELECT * FROM sample WHERE value IS NOT NULL),
asked AS (SELECT t.subject, n.track, t.slot, t.state FROM state t JOIN named n USING (subject)),
back AS (SELECT a.*, b.slot AS b_slot, b.value AS b_value FROM asked a ASOF LEFT JOIN seen b ON a.subject = b.subject AND a.track = b.track AND a.slot >= b.slot),
ahead AS (SELECT a.*, c.slot AS a_slot, c.value AS a_value FROM back a ASOF LEFT JOIN seen c ON a.subject = c.subject AND a.track = c.track AND a.slot <= c.slot)
SELECT subject, track, slot, state, b_value AS before_value, b_slot - slot AS before_offset, {_class("b_slot - slot")} AS before_class, a_value AS after_value, a_slot - slot AS after_offset, {_class("a_slot - slot")} AS after_class FROM ahead""",
)
def aligned_tracks(spark, sf_dir):
    return evidence.align_tracks(*tracks(spark, sf_dir))


@query(
    "track_relations",
    f"""WITH {TRACK_SQL},
peaks AS (SELECT subject, track, max(value) AS peak_value, arg_min(slot, CASE WHEN value IS NOT NULL THEN struct_pack(x := -value, y := slot) END) AS peak_slot FROM sample GROUP BY ALL),
points AS (SELECT subject, 'first_impaired' AS kind, min(slot) AS slot FROM state WHERE state = 'impaired' GROUP BY ALL UNION ALL SELECT subject, 'last_impaired', max(slot) FROM state WHERE state = 'impaired' GROUP BY ALL)
SELECT subject, track, kind, slot, peak_slot, peak_value, peak_slot - slot AS "offset", {_class("peak_slot - slot")} AS relation,
       CASE WHEN peak_slot IS NULL THEN 'unknown' WHEN peak_slot = slot THEN 'same_slot' WHEN peak_slot > slot THEN 'activity_after' ELSE 'activity_before' END AS direction
FROM points JOIN peaks USING (subject)""",
)
def track_relations(spark, sf_dir):
    states, samples = tracks(spark, sf_dir)
    hit = states.filter("state = 'impaired'").groupBy("subject")
    points = hit.agg(F.min("slot").alias("slot")).select("subject", F.lit("first_impaired").alias("kind"), "slot").union(hit.agg(F.max("slot").alias("slot")).select("subject", F.lit("last_impaired"), "slot"))
    return evidence.peak_relations(points, samples)


def session_timeline(spark, sf_dir):
    r = B.route_events(spark, sf_dir)
    routes = r.select("vp", F.col("epoch_s").alias("at"), (2 * F.col("event_id")).alias("ordinal"), "action", F.col("prefix").alias("prefix"), "as_path")
    steps = r.filter("event_id % 45 = 0").select("vp", F.col("epoch_s").alias("at"), (2 * F.col("event_id") + 1).alias("ordinal"), F.when(F.col("event_id") % 90 == 0, 6).otherwise(3).alias("old_state"), F.when(F.col("event_id") % 90 == 0, 1).when(F.col("event_id") % 7 == 0, 4).otherwise(6).alias("new_state"))
    return sessions.timeline(routes, steps)


@query(
    "session_reports",
    f"""WITH {B.ROUTE_SQL},
said AS (SELECT vp, prefix, epoch_s * 1000000 + 2 * event_id AS t, action = 'announce' AS here FROM route),
turns AS (
  SELECT vp, epoch_s AS "at", epoch_s * 1000000 + 2 * event_id + 1 AS t, CASE WHEN event_id % 90 = 0 THEN 'lost' ELSE 'up' END AS report FROM route WHERE event_id % 45 = 0 AND (event_id % 90 = 0 OR event_id % 7 <> 0)),
later AS (SELECT *, lead("at") OVER (PARTITION BY vp ORDER BY t) AS next_at FROM turns),
points AS (
  SELECT vp, "at", t, report FROM turns UNION ALL SELECT vp, "at" + {sessions.SETTLE}, ("at" + {sessions.SETTLE} + 1) * 1000000 - 1, 'settled' FROM later WHERE report = 'up' AND (next_at IS NULL OR next_at > "at" + {sessions.SETTLE})),
asked AS (SELECT p.*, x.prefix FROM points p JOIN (SELECT DISTINCT vp, prefix FROM route) x USING (vp)),
held AS (SELECT a.*, s.t AS said_at, s.here FROM asked a ASOF LEFT JOIN said s ON a.vp = s.vp AND a.prefix = s.prefix AND a.t >= s.t),
cut AS (SELECT h.*, l.t AS lost_at FROM held h ASOF LEFT JOIN (SELECT vp, t FROM turns WHERE report = 'lost') l ON h.vp = l.vp AND h.t > l.t)
SELECT vp, "at", report, count(*) FILTER (here AND (lost_at IS NULL OR said_at > lost_at)) AS known, count(*) FILTER (here AND said_at < lost_at) AS unknown FROM cut GROUP BY vp, "at", t, report""",
)
def session_reports(spark, sf_dir):
    """A second has a million ordinals, as in the SQL."""
    return sessions.session_reports(session_timeline(spark, sf_dir), ordinals=1_000_000)


@query(
    "caught_up_routes",
    f"""WITH {B.ROUTE_SQL},
seed AS (SELECT vp, prefix, arg_max(as_path, event_id) AS as_path, max(epoch_s) AS "at", max(event_id) AS ordinal FROM route WHERE epoch_s < {I.FIRST_S} + 5 * {DAY} AND action = 'announce' GROUP BY ALL),
rows AS (
  SELECT vp, prefix, 0 AS source, "at", ordinal, 'announce' AS action, as_path FROM seed
  UNION ALL SELECT vp, prefix, 1, epoch_s, event_id, action, as_path FROM route WHERE epoch_s >= {I.FIRST_S} + 5 * {DAY} AND epoch_s < {I.FIRST_S} + 12 * {DAY}),
last AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY vp, prefix ORDER BY source DESC, "at" DESC, ordinal DESC) = 1),
gaps AS (SELECT vp, list_sort(list(DISTINCT reason)) AS missing_reasons FROM (SELECT vp, CASE WHEN event_id % 2 = 0 THEN 'bad_artifact' ELSE 'missing_artifact' END AS reason FROM route WHERE vp % 2 = 0 AND event_id % 997 = 3 AND epoch_s < {I.FIRST_S} + 12 * {DAY}) GROUP BY vp)
SELECT vp, prefix, "at", ordinal, as_path, CASE WHEN g.vp IS NULL THEN 'continuous' ELSE 'unknown_after_gap' END AS continuity, coalesce(array_to_string(missing_reasons, ','), '') AS missing_reasons FROM last LEFT JOIN gaps g USING (vp) WHERE action <> 'withdraw'""",
)
def caught_up_routes(spark, sf_dir):
    r = B.route_events(spark, sf_dir).withColumns({"at": F.col("epoch_s"), "ordinal": F.col("event_id")})
    start = I.FIRST_S + 5 * DAY
    last = r.filter(f"at < {start} AND action = 'announce'").groupBy("vp", "prefix").agg(F.max_by("as_path", "event_id").alias("as_path"), F.max("at").alias("at"), F.max("ordinal").alias("ordinal"))
    gaps = r.filter("vp % 2 = 0 AND event_id % 997 = 3").select("vp", F.col("at").alias("missing_from"), (F.col("at") + 300).alias("missing_to"), F.when(F.col("event_id") % 2 == 0, "bad_artifact").otherwise("missing_artifact").alias("reason"))
    found = sessions.catch_up(last, r.filter(f"at >= {start}"), gaps, I.FIRST_S + 12 * DAY)
    return found.withColumn("missing_reasons", F.array_join("missing_reasons", ","))
