"""Queries over populations, incidents, multi-valued entities and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts, events, graph, joins, state
from . import bindings as B
from .registry import query
from .route_queries import EDGES_SQL, KEY, ORDER
from .series_queries import DAILY, daily

LAST = "last_routes AS (SELECT vp, prefix_id, last(origin ORDER BY epoch_s, event_id) AS origin, last(action ORDER BY epoch_s, event_id) AS action FROM {} GROUP BY vp, prefix_id)"
CUT = 1_704_672_000


@query("cohort_first_seen", f"WITH {B.ROUTE_SQL} SELECT prefix_id, origin, min(epoch_s) AS first_seen FROM route WHERE origin IS NOT NULL GROUP BY ALL")
def cohort_first_seen(spark, sf_dir):
    return cohorts.first_seen(B.route_events(spark, sf_dir).filter("origin IS NOT NULL"), ["prefix_id", "origin"], "epoch_s")


CLASS_SQL = f"""{B.ROUTE_SQL}, e AS (SELECT vp, prefix_id, last(action ORDER BY epoch_s, event_id) AS action FROM route WHERE epoch_s < {CUT} GROUP BY ALL),
n AS (SELECT vp, prefix_id, last(action ORDER BY epoch_s, event_id) AS action FROM route GROUP BY ALL),
c AS (SELECT prefix_id, count(DISTINCT vp) AS expected FROM e WHERE action <> 'withdraw' GROUP BY 1), v AS (SELECT prefix_id, count(DISTINCT vp) AS visible FROM n WHERE action <> 'withdraw' GROUP BY 1),
k AS (SELECT prefix_id, expected, coalesce(visible, 0) AS visible, CASE WHEN coalesce(visible, 0) = 0 THEN 'complete' WHEN visible < expected THEN 'partial' ELSE 'normal' END AS loss FROM c LEFT JOIN v USING (prefix_id))"""


def classes(spark, sf_dir):
    e = B.route_events(spark, sf_dir)
    cohort = cohorts.expected_directions(state.replay(e.filter(F.col("epoch_s") < CUT), KEY, ORDER), "prefix_id", "vp")
    return cohorts.direction_classes(cohort, state.replay(e, KEY, ORDER), "prefix_id", "vp")


@query("direction_classes", f"WITH {CLASS_SQL} SELECT * FROM k")
def direction_classes(spark, sf_dir):
    return classes(spark, sf_dir)


@query(
    "asn_classes",
    f"""WITH {CLASS_SQL}, a AS (SELECT prefix_id % 40 AS asn, count(*) AS members, count(*) FILTER (loss = 'complete') AS complete, count(*) FILTER (loss = 'normal') AS normal FROM k GROUP BY 1)
SELECT *, CASE WHEN complete = members THEN 'complete' WHEN normal = members THEN 'normal' ELSE 'partial' END AS loss FROM a""",
)
def asn_classes(spark, sf_dir):
    return cohorts.roll_up_classes(classes(spark, sf_dir).withColumn("asn", F.col("prefix_id") % 40), "asn")


@query("milestones", f"WITH {B.ROUTE_SQL} SELECT prefix_id, min(CASE WHEN action = 'withdraw' THEN epoch_s END) AS first_withdraw, min(CASE WHEN event_id % 13 = 0 AND origin IS NOT NULL THEN epoch_s END) AS first_other_origin FROM route GROUP BY 1")
def milestones(spark, sf_dir):
    other = (F.col("event_id") % 13 == 0) & F.col("origin").isNotNull()
    return cohorts.milestones(B.route_events(spark, sf_dir), ["prefix_id"], "epoch_s", first_withdraw=F.col("action") == "withdraw", first_other_origin=other)


@query(
    "incidents",
    """WITH e AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey END AS k FROM orders), f AS (SELECT l_orderkey AS k, count(*) AS n, min(l_partkey) AS first_fact FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT event_id, coalesce(n, 0) AS n_facts, first_fact, CASE WHEN e.k IS NULL THEN 'quarantined' WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'collision' ELSE 'matched' END AS status FROM e LEFT JOIN f ON e.k = f.k""",
)
def incidents(spark, sf_dir):
    e = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderkey")).alias("k"))
    f = B.read(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("k"), "l_partkey")
    return cohorts.incidents(e, f, "k", "l_partkey").select("event_id", "n_facts", "first_fact", "status")


@query(
    "entity_weights",
    """WITH t AS (SELECT event_id, 'AS' || (user_id % 30) || ', AS' || (event_id % 7) || ',AS' || (user_id % 30) AS names, event_type = 'error' AS high FROM events), x AS (SELECT DISTINCT event_id, trim(unnest(string_split(names, ','))) AS entity, high FROM t)
SELECT entity, count(*) AS n_rows, CAST(sum(event_id % 5) AS BIGINT) AS weight, count(*) FILTER (high) AS n_high FROM x GROUP BY entity""",
)
def entity_weights(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    name = lambda c: F.concat(F.lit("AS"), c.cast("string"))
    names = F.concat(name(F.col("user_id") % 30), F.lit(", "), name(F.col("event_id") % 7), F.lit(","), name(F.col("user_id") % 30))
    rows = e.select(names.alias("names"), (F.col("event_id") % 5).alias("w"), "event_type")
    return cohorts.entity_weights(rows, "names", "w", F.col("event_type") == "error")


@query(
    "priority_lists",
    f"""WITH {B.OUTAGE_SQL}, r AS (SELECT country, event_id, amount, row_number() OVER (PARTITION BY country ORDER BY amount DESC, event_id) AS scale_rank, row_number() OVER (PARTITION BY country ORDER BY end_s - start_s DESC NULLS FIRST, event_id) AS lasting_rank FROM outage)
SELECT * FROM r WHERE scale_rank <= 3 OR lasting_rank <= 3""",
)
def priority_lists(spark, sf_dir):
    o = B.outages(spark, sf_dir)
    lasting = [F.desc_nulls_first("seconds"), F.asc("event_id")]
    rows = o.select("country", "event_id", "amount", (F.col("end_s") - F.col("start_s")).alias("seconds"))
    return cohorts.priority_lists(rows, [F.desc("amount"), F.asc("event_id")], lasting, 3, "country").drop("seconds")


@query(
    "candidate_pick",
    f"""WITH {B.OUTAGE_SQL}, a AS (SELECT asn, count(*) AS n, sum(amount) AS s FROM outage GROUP BY asn), r AS (SELECT asn, row_number() OVER (ORDER BY n DESC, asn) AS r1, row_number() OVER (ORDER BY s DESC, asn) AS r2 FROM a),
u AS (SELECT asn, r1 AS position FROM r WHERE r1 <= 100 UNION ALL SELECT asn, 1000000 + r2 FROM r WHERE r2 <= 50) SELECT asn, min(position) AS position FROM u GROUP BY asn""",
)
def candidate_pick(spark, sf_dir):
    a = B.outages(spark, sf_dir).groupBy("asn").agg(F.count("*").alias("n"), F.sum("amount").alias("s"))
    by_count = events.first_n(a, 100, [F.desc("n"), F.asc("asn")])
    by_sum = events.first_n(a, 50, [F.desc("s"), F.asc("asn")])
    return cohorts.candidates([(by_count, 100), (by_sum, 50)], "asn")


@query(
    "sticky_origins",
    f"""WITH {B.ROUTE_SQL}, l AS (SELECT *, sum((action = 'withdraw')::INT) OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s, event_id ROWS UNBOUNDED PRECEDING) AS life FROM route),
n AS (SELECT *, (origin IS NOT NULL AND row_number() OVER (PARTITION BY vp, prefix_id, life, origin ORDER BY epoch_s, event_id) = 1)::INT AS new FROM l)
SELECT vp, prefix_id, epoch_s, event_id, CAST(sum(new) OVER (PARTITION BY vp, prefix_id, life ORDER BY epoch_s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS origins FROM n""",
)
def sticky_origins(spark, sf_dir):
    return cohorts.sticky_origins(B.route_events(spark, sf_dir), KEY, ORDER, "origin")


@query(
    "nodes_and_links",
    f"""WITH {EDGES_SQL}, c AS (SELECT a.s_nationkey AS place, low, high FROM edges JOIN supplier a ON a.s_suppkey = low JOIN supplier b ON b.s_suppkey = high AND a.s_nationkey = b.s_nationkey),
n AS (SELECT DISTINCT place, unnest([low, high]) AS asn FROM c)
SELECT place, count(*) AS n_nodes, count(*) FILTER (s_acctbal < 0) AS n_affected, (SELECT count(*) FROM c x WHERE x.place = n.place) AS n_links FROM n JOIN supplier ON s_suppkey = asn GROUP BY place""",
)
def nodes_and_links(spark, sf_dir):
    s = B.read(spark, sf_dir, "supplier")
    places = s.select(F.col("s_suppkey").alias("asn"), F.col("s_nationkey").alias("country"))
    edges = graph.inside_country(graph.adjacency(B.paths(spark, sf_dir)), places).withColumnRenamed("country", "place")
    return cohorts.nodes_and_links(edges, "place", s.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("asn")))


@query(
    "pattern_features",
    f"""WITH {DAILY}, m AS (SELECT asn, slot, v / max(v) OVER (PARTITION BY asn) AS r, max(v) OVER (PARTITION BY asn) AS den FROM d),
x AS (SELECT *, round((r - lag(r) OVER (PARTITION BY asn ORDER BY slot)) * 100, 9) AS d FROM m),
moves AS (SELECT asn, slot, sign(d) AS s, lag(sign(d)) OVER (PARTITION BY asn ORDER BY slot) AS before FROM x WHERE abs(d) >= 2),
mv AS (SELECT asn, count(*) AS moves, count(*) FILTER (s <> before) AS turns, min(slot) FILTER (s > 0) AS first_rise FROM moves GROUP BY asn),
f AS (SELECT asn, max(den) AS denominator, round((max(r) - min(r)) * 100, 6) AS range_points, round(coalesce(sum(abs(d)), 0), 6) AS variation, count(*) FILTER (d <= -8) AS drops,
  arg_min(slot, (r, slot)) AS extreme_slot, arg_min(r, slot) AS first_r, arg_max(r, slot) AS last_r, max(slot) AS last_slot, min(r) AS least FROM x GROUP BY asn),
g AS (SELECT f.*, coalesce(moves, 0) AS moves, coalesce(turns, 0) AS turns, first_rise FROM f LEFT JOIN mv USING (asn))
SELECT asn, denominator, range_points, variation, moves, turns, drops, extreme_slot,
  CASE WHEN denominator < 10 THEN 'small_denominator' WHEN range_points <= 2 AND variation <= 10 THEN 'plateau'
       WHEN moves >= 8 AND turns / (moves - 1) >= 0.8 AND variation >= 50 THEN 'oscillation' WHEN drops >= 2 THEN 'multi_wave'
       WHEN drops = 1 AND (first_rise IS NULL OR first_rise > extreme_slot) AND extreme_slot < last_slot AND last_r > least
         THEN CASE WHEN last_r < first_r THEN 'single_wave_partial_rebound' WHEN last_r = first_r THEN 'single_wave_return_to_window_start' ELSE 'single_wave_above_window_start' END
       WHEN drops > 0 THEN 'mixed' ELSE 'unmatched' END AS pattern FROM g""",
)
def pattern_features(spark, sf_dir):
    d = daily(spark, sf_dir)
    shares = d.join(d.groupBy("asn").agg(F.max("v").alias("most")), "asn").select("asn", "slot", (F.col("v") / F.col("most")).alias("ratio"), "most")
    return cohorts.pattern_features(shares, ["asn"], "slot", "ratio", "most")


@query("early_drop", f"WITH {B.ROUTE_SQL} SELECT origin, count(*) AS n FROM route WHERE origin IS NOT NULL AND origin - 3000 NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY origin")
def early_drop(spark, sf_dir):
    gone = B.read(spark, sf_dir, "customer").filter("c_nationkey = 3").select((F.col("c_custkey") + 3000).alias("origin"))
    kept = B.route_events(spark, sf_dir).filter("origin IS NOT NULL").join(gone, "origin", "left_anti")
    return kept.groupBy("origin").agg(F.count("*").alias("n"))


@query("rows_per_key", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT n AS rows_of_key, count(*) AS n_keys FROM c GROUP BY n")
def rows_per_key(spark, sf_dir):
    counts = B.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.groupBy(F.col("n").alias("rows_of_key")).agg(F.count("*").alias("n_keys"))


@query(
    "triplet_lookup",
    f"""WITH {B.ROUTE_SQL}, t AS (SELECT DISTINCT event_id, string_split(as_path, ' ')[1]::BIGINT AS a, string_split(as_path, ' ')[2]::BIGINT AS b FROM route WHERE as_path IS NOT NULL), k AS (SELECT 100 + s_suppkey % 6 AS a, 200 + s_suppkey % 9 AS b, max(s_acctbal) / 10000 AS stability FROM supplier GROUP BY ALL)
SELECT event_id, coalesce(stability, 0) AS stability, coalesce(stability, 0) >= 0.2 AS skipped FROM t LEFT JOIN k USING (a, b)""",
)
def triplet_lookup(spark, sf_dir):
    hop = lambda k: F.get(F.split("as_path", " "), k).cast("bigint")
    routes = B.route_events(spark, sf_dir).filter("as_path IS NOT NULL").select("event_id", hop(0).alias("a"), hop(1).alias("b"))
    s = B.read(spark, sf_dir, "supplier")
    known = s.groupBy((100 + F.col("s_suppkey") % 6).alias("a"), (200 + F.col("s_suppkey") % 9).alias("b")).agg((F.max("s_acctbal") / 10000).alias("stability"))
    return joins.stability_of(routes, known, ["a", "b"])
