"""Queries of data quality, reconciliation and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digests, joins, quality, state
from . import bindings as B
from .registry import query

PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(
    "table_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER ({c}::VARCHAR = '') AS n_empty, count(*) FILTER (try_cast({c}::VARCHAR AS DOUBLE) = 0) AS n_zero, count(DISTINCT {c}) AS n_distinct FROM orders"
        for c in PROFILED
    ),
)
def table_profile(spark, sf_dir):
    return quality.profile(B.read(spark, sf_dir, "orders"), PROFILED)


CHECKS_SQL = {
    "price_positive": "l_extendedprice > 0",
    "discount_share": "l_discount BETWEEN 0 AND 1",
    "quantity_small": "l_quantity <= 45",
    "net_at_most_gross": "l_extendedprice * (1 - l_discount) <= l_extendedprice",
}
FINDINGS = " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) AS n_checked, count(*) FILTER (NOT coalesce({v}, false)) AS n_failed FROM lineitem" for k, v in CHECKS_SQL.items())


def findings(spark, sf_dir):
    return quality.violations(B.read(spark, sf_dir, "lineitem"), {k: F.expr(v) for k, v in CHECKS_SQL.items()})


@query("identity_checks", FINDINGS)
def identity_checks(spark, sf_dir):
    return findings(spark, sf_dir)


@query("quality_gate", f"WITH f AS ({FINDINGS}), g AS (SELECT *, CASE WHEN n_checked = 0 THEN 'pending' WHEN n_failed = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM f) SELECT *, verdict = 'fail' AND check_name IN ('quantity_small') AS blocking FROM g")
def quality_gate(spark, sf_dir):
    return quality.gate(findings(spark, sf_dir), ["quantity_small"])


@query("fact_collisions", "SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS n_incidents, min(l_orderkey) AS first_incident, max(l_orderkey) AS last_incident FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) > 1")
def fact_collisions(spark, sf_dir):
    return quality.collisions(B.read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query("ambiguous_keys", "SELECT user_id, epoch(date_trunc('minute', ts))::BIGINT AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def ambiguous_keys(spark, sf_dir):
    rows = B.read(spark, sf_dir, "events").withColumn("minute", F.unix_timestamp(F.date_trunc("minute", "ts")))
    return quality.duplicates(rows, ["user_id", "minute"])


@query(
    "mapping_freeze",
    """WITH v AS (SELECT l_suppkey AS asn, (l_orderkey * 10 + l_linenumber) * 100 + ascii(l_returnflag) AS row_no, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS country FROM lineitem),
f AS (SELECT asn, arg_min(country, row_no) FILTER (country IS NOT NULL) AS chosen FROM v GROUP BY asn)
SELECT v.asn, any_value(chosen) AS chosen, count(*) FILTER (country = chosen) AS n_same, count(*) FILTER (country IS NOT NULL AND country <> chosen) AS n_conflict, count(*) FILTER (country IS NULL) AS n_invalid
FROM v JOIN f ON f.asn = v.asn GROUP BY v.asn""",
)
def mapping_freeze(spark, sf_dir):
    i = B.read(spark, sf_dir, "lineitem")
    rows = i.select(F.col("l_suppkey").alias("asn"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.ascii("l_returnflag")).alias("row_no"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("country"))
    return quality.first_valid(rows, "asn", "country", "row_no", F.col("country").isNotNull())


@query(
    "claim_reconciliation",
    "WITH t AS (SELECT l_orderkey AS event_id, round(sum(l_extendedprice), 2) AS actual FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), c AS (SELECT o_orderkey AS event_id, o_totalprice AS claimed FROM orders) SELECT event_id, claimed, actual, CASE WHEN actual IS NULL THEN 'unverifiable' WHEN abs(claimed - actual) <= 50000 THEN 'confirmed' ELSE 'revised' END AS verdict FROM c LEFT JOIN t USING (event_id)",
)
def claim_reconciliation(spark, sf_dir):
    truth = B.read(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("actual"))
    claims = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("claimed"))
    return quality.reconcile(claims, truth, ["event_id"], "claimed", "actual", 50_000.0)


@query(
    "row_difference",
    "WITH a AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') (SELECT *, 'only_a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'only_b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))",
)
def row_difference(spark, sf_dir):
    i = B.read(spark, sf_dir, "lineitem")
    return digests.row_difference(*[i.filter(F.col("l_returnflag") == x).select("l_suppkey", "l_linenumber") for x in "AR"])


@query(
    "conservation",
    f"""WITH {B.OUTAGE_SQL}, c AS (SELECT count(*) AS total FROM outage), s AS (SELECT sum(n) AS parts FROM (SELECT country, count(*) AS n FROM outage GROUP BY country)) SELECT total, CAST(parts AS BIGINT) AS parts, total = parts AS holds FROM c, s""",
)
def conservation(spark, sf_dir):
    o = B.outages(spark, sf_dir)
    parts = o.groupBy("country").agg(F.count("*").alias("n"))
    both = o.agg(F.count("*").alias("total")).withColumn("k", F.lit(1)).join(parts.agg(F.sum("n").alias("parts")).withColumn("k", F.lit(1)), "k")
    return both.select("total", "parts", (F.col("total") == F.col("parts")).alias("holds"))


REPLAY_KEYS, REPLAY_ORDER = ["vp", "prefix_id"], ["epoch_s", "event_id"]
NOON = 1705276800
#: Where some updates were lost on the way: what a snapshot has and the replay has not, and the reverse.
STATES_SQL = f"""WITH {B.ROUTE_SQL},
anchor AS (SELECT vp, prefix_id, origin, as_path FROM route WHERE epoch_s < {NOON} QUALIFY row_number() OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s DESC, event_id DESC) = 1 AND action <> 'withdraw'),
replayed AS (SELECT vp, prefix_id, origin, as_path FROM route WHERE epoch_s < {NOON} AND event_id % 41 <> 0 QUALIFY row_number() OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s DESC, event_id DESC) = 1 AND action <> 'withdraw'),
marked AS (
  SELECT side, n, md5(vp || chr(31) || prefix_id) AS k, md5(concat_ws(chr(31), vp, prefix_id, coalesce(origin::VARCHAR, chr(1)), coalesce(as_path, chr(1)))) AS d
  FROM (SELECT 'a' AS side, 1 AS n, * FROM anchor UNION ALL SELECT 'b', 1, * FROM replayed)),
tree AS (
  SELECT side, level, substr(k, 1, level::INT) AS node, count(*) AS n_rows, sum(('0x' || substr(d, 1, 15))::BIGINT) AS high, sum(('0x' || substr(d, 16, 15))::BIGINT) AS low
  FROM marked, range(4) l(level) GROUP BY ALL),
sides AS (SELECT level, node, max(n_rows) FILTER (side = 'a') AS na, max(n_rows) FILTER (side = 'b') AS nb, count(DISTINCT (n_rows, high, low)) AS kinds, count(*) AS n FROM tree GROUP BY level, node),
differ AS (SELECT level, node, coalesce(na, 0) AS rows_a, coalesce(nb, 0) AS rows_b, CASE WHEN na IS NULL THEN 'only_b' WHEN nb IS NULL THEN 'only_a' ELSE 'differs' END AS status FROM sides WHERE kinds > 1 OR n = 1)"""


def both_states(spark, sf_dir):
    events = B.route_events(spark, sf_dir).filter(F.col("epoch_s") < NOON)
    return [state.replay(x, REPLAY_KEYS, REPLAY_ORDER) for x in (events, events.filter("event_id % 41 <> 0"))]


def as_text(sums):
    """Sums of digests as text: they have more digits than a floating number."""
    return sums.withColumns({c: F.col(c).cast("string") for c in ("high", "low")})


@query(
    "state_digest",
    f"""{STATES_SQL}, now AS (
  SELECT md5(concat_ws(chr(31), vp, prefix_id, as_path)) AS d FROM route QUALIFY row_number() OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s DESC, event_id DESC) = 1 AND action <> 'withdraw')
SELECT count(*) AS n_rows, sum(('0x' || substr(d, 1, 15))::BIGINT)::VARCHAR AS high, sum(('0x' || substr(d, 16, 15))::BIGINT)::VARCHAR AS low FROM now""",
)
def state_digest(spark, sf_dir):
    return as_text(digests.digest(state.replay(B.route_events(spark, sf_dir), REPLAY_KEYS, REPLAY_ORDER), [*REPLAY_KEYS, "as_path"]))


@query("section_tree", f"{STATES_SQL} SELECT level::INT AS level, node, n_rows, high::VARCHAR AS high, low::VARCHAR AS low FROM tree WHERE side = 'a'")
def section_tree(spark, sf_dir):
    return as_text(digests.section_tree(both_states(spark, sf_dir)[0], REPLAY_KEYS, [*REPLAY_KEYS, "origin", "as_path"]))


@query("tree_difference", f"{STATES_SQL} SELECT level::INT AS level, node, rows_a, rows_b, status FROM differ")
def tree_difference(spark, sf_dir):
    return digests.tree_difference(*[digests.section_tree(x, REPLAY_KEYS, [*REPLAY_KEYS, "origin", "as_path"]) for x in both_states(spark, sf_dir)])


@query(
    "snapshot_reconciliation",
    f"""{STATES_SQL} SELECT (SELECT count(DISTINCT node) FROM tree WHERE level = 3) AS sections, (SELECT count(*) FROM anchor) AS rows_anchor, (SELECT count(*) FROM replayed) AS rows_replayed,
  (SELECT count(*) FROM differ WHERE level = 3) AS differing, CASE WHEN (SELECT count(*) FROM differ) > 0 THEN 'mismatch' ELSE 'consistent' END AS status""",
)
def snapshot_reconciliation(spark, sf_dir):
    return digests.reconcile_states(*both_states(spark, sf_dir), REPLAY_KEYS, ["origin", "as_path"])[0]


@query(
    "snapshot_differences",
    f"{STATES_SQL} (SELECT *, 'only_a' AS side FROM (SELECT * FROM anchor EXCEPT ALL SELECT * FROM replayed)) UNION ALL (SELECT *, 'only_b' FROM (SELECT * FROM replayed EXCEPT ALL SELECT * FROM anchor))",
)
def snapshot_differences(spark, sf_dir):
    return digests.reconcile_states(*both_states(spark, sf_dir), REPLAY_KEYS, ["origin", "as_path"])[1]


@query("private_asn_counts", "SELECT CASE WHEN o_custkey * 50 BETWEEN 64512 AND 65535 THEN 'private' ELSE 'public' END AS kind, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_asns FROM orders GROUP BY ALL")
def private_asn_counts(spark, sf_dir):
    from ..functions.scalars import is_private_asn

    kind = F.when(is_private_asn((F.col("o_custkey") * 50).cast("string")), "private").otherwise("public").alias("kind")
    return B.read(spark, sf_dir, "orders").groupBy(kind).agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_asns"))


@query(
    "cohort_visibility",
    f"""WITH {B.ROUTE_SQL}, early AS (SELECT vp, prefix_id, arg_max(origin, (epoch_s, event_id)) AS origin, arg_max(action, (epoch_s, event_id)) AS action FROM route WHERE epoch_s < 1704672000 GROUP BY ALL),
late AS (SELECT vp, prefix_id, last(origin ORDER BY epoch_s, event_id) AS origin, last(action ORDER BY epoch_s, event_id) AS action FROM route GROUP BY ALL),
e AS (SELECT vp, prefix_id, last(origin ORDER BY epoch_s, event_id) AS origin, last(action ORDER BY epoch_s, event_id) AS action FROM route WHERE epoch_s < 1704672000 GROUP BY ALL)
SELECT e.vp, count(*) AS members, count(*) FILTER (l.action <> 'withdraw' AND l.origin = e.origin) AS visible FROM e LEFT JOIN late l ON e.vp = l.vp AND e.prefix_id = l.prefix_id WHERE e.action <> 'withdraw' GROUP BY e.vp""",
)
def cohort_visibility(spark, sf_dir):
    events, key, order = B.route_events(spark, sf_dir), ["vp", "prefix_id"], ["epoch_s", "event_id"]
    cohort = state.replay(events.filter("epoch_s < 1704672000"), key, order).select(*key, "origin")
    return joins.visible_cohort(cohort, state.replay(events, key, order), key).groupBy("vp").agg(F.count("*").alias("members"), F.count_if("visible").alias("visible"))


@query(
    "mapping_views",
    "WITH d AS (SELECT s_suppkey AS asn, s_nationkey AS place FROM supplier WHERE s_acctbal > 0), b AS (SELECT c_custkey AS asn, c_nationkey AS place FROM customer) SELECT coalesce(b.asn, d.asn) AS asn, coalesce(d.place, b.place) AS place, CASE WHEN d.place IS NOT NULL THEN 'delta' ELSE 'base' END AS view FROM b FULL JOIN d ON b.asn = d.asn",
)
def mapping_views(spark, sf_dir):
    base = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asn"), F.col("c_nationkey").alias("place"))
    delta = B.read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("asn"), F.col("s_nationkey").alias("place"))
    return joins.mapping_union(base, delta, "asn", "place")
