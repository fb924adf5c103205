"""Queries over fixed populations: live coverage, event series, simultaneous losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concurrency, coverage, resources
from . import bindings as B
from .registry import SQL, query

#: Six-hour slots from the first day of the events, and the last of them.
FIRST_S, SLOT_S, LAST_SLOT = 1704067200, 21600, 119


def prefixes(df):
    """Names of the prefixes: four of each block lie in each other, every other block is IPv6; eight prefixes are of one country."""
    p, block = F.col("prefix_id"), F.expr("prefix_id div 4")
    afi = F.when(block % 2 == 0, 4).otherwise(6)
    unit, base = F.when(afi == 4, 256).otherwise(1), F.when(afi == 4, F.lit(10 << 24)).otherwise(F.lit(0x20010DB8 << 16))
    longest = F.when(afi == 4, 24).otherwise(48)
    network = base + block * 4 * unit + F.when(p % 4 == 2, 2).otherwise(0) * unit
    return df.withColumns({"event": F.expr("(prefix_id div 8) % 5"), "afi": afi, "network": network.cast("bigint"), "length": (longest - F.when(p % 4 == 0, 2).when(p % 4 == 1, 1).otherwise(0)).cast("int")})


def states(spark, sf_dir):
    """(event, prefix, afi, network, length, direction, slot, up, d)."""
    routes = B.route_events(spark, sf_dir).withColumn("slot", F.expr(f"(epoch_s - {FIRST_S}) div {SLOT_S}"))
    ends = coverage.slot_ends(routes, ["prefix_id", "vp"], ["epoch_s", "event_id"])
    return prefixes(ends).withColumnsRenamed({"prefix_id": "prefix", "vp": "direction"})


def cohorts(rows):
    return rows.select("event").distinct().select("event", (F.lit(10) + F.col("event")).cast("bigint").alias("cohort_slot"), F.lit(LAST_SLOT).cast("bigint").alias("last_slot"))


def origins(rows):
    """(event, prefix, asn): one AS, or two."""
    own, other = F.expr("3000 + (prefix div 2) % 20"), F.when(F.col("prefix") % 7 == 0, F.expr("3000 + (prefix div 3) % 20"))
    return rows.select("event", "prefix").distinct().select("event", "prefix", F.explode(F.array_distinct(F.array_compact(F.array(own, other)))).alias("asn"))


STATE_SQL = f"""{B.ROUTE_SQL},
obs AS (
  SELECT prefix_id AS prefix, vp AS direction, (epoch_s - {FIRST_S}) // {SLOT_S} AS slot, ((array_agg(action ORDER BY epoch_s DESC, event_id DESC))[1] <> 'withdraw')::INT AS up
  FROM route GROUP BY ALL),
named AS (
  SELECT prefix, (prefix // 8) % 5 AS event, CASE WHEN (prefix // 4) % 2 = 0 THEN 4 ELSE 6 END AS afi,
         CASE WHEN (prefix // 4) % 2 = 0 THEN {10 << 24} + (prefix // 4) * 1024 + CASE WHEN prefix % 4 = 2 THEN 512 ELSE 0 END
              ELSE {0x20010DB8 << 16} + (prefix // 4) * 4 + CASE WHEN prefix % 4 = 2 THEN 2 ELSE 0 END END AS network,
         CASE WHEN (prefix // 4) % 2 = 0 THEN 24 ELSE 48 END - CASE prefix % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS length,
         (1::BIGINT << (CASE WHEN (prefix // 4) % 2 = 0 THEN 32 ELSE 48 END - length)) AS size
  FROM (SELECT DISTINCT prefix FROM obs))"""


@query(
    "live_coverage",
    f"""WITH {STATE_SQL},
slots AS (SELECT DISTINCT event, afi, direction, slot FROM obs JOIN named USING (prefix)),
seen AS (SELECT s.event, s.afi, s.direction, s.slot, n.prefix, n.network, n.length, n.size FROM slots s JOIN named n ON s.event = n.event AND s.afi = n.afi
  WHERE (SELECT arg_max(o.up, o.slot) FROM obs o WHERE o.prefix = n.prefix AND o.direction = s.direction AND o.slot <= s.slot) > 0),
top AS (SELECT * FROM seen a WHERE NOT EXISTS (
  SELECT 1 FROM seen b WHERE b.event = a.event AND b.afi = a.afi AND b.direction = a.direction AND b.slot = a.slot AND b.network <= a.network AND b.network + b.size >= a.network + a.size AND b.length < a.length)),
totals AS (SELECT s.event, s.afi, s.direction, s.slot, coalesce(sum(t.size), 0)::BIGINT AS covered FROM slots s LEFT JOIN (SELECT DISTINCT event, afi, direction, slot, network, size FROM top) t USING (event, afi, direction, slot) GROUP BY ALL),
steps AS (SELECT *, coalesce(lag(covered) OVER (PARTITION BY event, afi, direction ORDER BY slot), 0) AS before FROM totals)
SELECT event, afi, direction, slot, covered FROM steps WHERE covered <> before""",
)
def live_coverage(spark, sf_dir):
    return coverage.live_coverage(states(spark, sf_dir), ["event", "afi", "direction"], coverage.family_bits(F.col("afi")))


COHORT_SQL = f"""{STATE_SQL},
events AS (SELECT DISTINCT event, 10 + event AS cohort_slot FROM named),
dirs AS (SELECT DISTINCT n.event, o.prefix, o.direction FROM obs o JOIN named n USING (prefix)),
grid AS (SELECT d.*, e.cohort_slot, unnest(range(e.cohort_slot, {LAST_SLOT + 1})) AS slot FROM dirs d JOIN events e USING (event)),
held AS (SELECT g.*, coalesce(o.up, 0) AS up FROM grid g ASOF LEFT JOIN obs o ON g.prefix = o.prefix AND g.direction = o.direction AND g.slot >= o.slot),
chosen AS (SELECT event, prefix, direction FROM held WHERE slot = cohort_slot AND up = 1),
classed AS (
  SELECT event, prefix, slot, sum(up) AS visible, count(*) AS expected, CASE WHEN sum(up) = count(*) THEN 'normal' WHEN sum(up) > 0 THEN 'partially_interrupted' ELSE 'completely_interrupted' END AS class
  FROM held SEMI JOIN chosen USING (event, prefix, direction) GROUP BY ALL),
origins AS (
  SELECT event, prefix, 3000 + (prefix // 2) % 20 AS asn FROM named UNION SELECT event, prefix, 3000 + (prefix // 3) % 20 FROM named WHERE prefix % 7 = 0),
asns AS (
  SELECT event, asn, slot, count(*) FILTER (class = 'partially_interrupted') AS partial, count(*) FILTER (class = 'completely_interrupted') AS complete, count(*) AS total, sum(expected - visible) AS invisible,
         CASE WHEN count(*) FILTER (class = 'completely_interrupted') = count(*) THEN 'route_interrupted' WHEN count(*) FILTER (class <> 'normal') > 0 THEN 'affected' ELSE 'normal' END AS class
  FROM classed JOIN origins USING (event, prefix) GROUP BY ALL)"""


def _covered(rows: str) -> str:
    """Addresses and blocks of the rows (event, slot, prefix) that are in no other of them."""
    return f"""SELECT event, slot, sum(size) FILTER (afi = 4) AS addresses, sum(size) FILTER (afi = 6) AS blocks_48, count(*) FILTER (afi = 4) AS v4, count(*) FILTER (afi = 6) AS v6 FROM (
      SELECT r.event, r.slot, n.afi, n.size FROM {rows} r JOIN named n USING (prefix) WHERE NOT EXISTS (
        SELECT 1 FROM {rows} x JOIN named m ON x.prefix = m.prefix WHERE x.event = r.event AND x.slot = r.slot AND m.afi = n.afi AND m.length < n.length AND m.network <= n.network AND m.network + m.size >= n.network + n.size)) GROUP BY ALL"""


@query(
    "event_series",
    f"""WITH {COHORT_SQL},
fixed AS (SELECT event, slot, prefix FROM classed WHERE visible > 0),
present AS (SELECT event, prefix, slot FROM held ANTI JOIN chosen USING (event, prefix) WHERE slot > cohort_slot GROUP BY ALL HAVING sum(up) > 0),
ever AS (SELECT p.event, p.prefix, unnest(range(p.slot, {LAST_SLOT + 1})) AS slot FROM (SELECT event, prefix, min(slot) AS slot FROM present GROUP BY ALL) p),
fixed_cover AS ({_covered("fixed")}), new_cover AS ({_covered("present")}), ever_cover AS ({_covered("ever")}),
news AS (SELECT event, slot, count(*) FILTER (afi = 4) AS v4, count(*) FILTER (afi = 6) AS v6 FROM present JOIN named USING (event, prefix) GROUP BY ALL),
evers AS (SELECT event, slot, count(*) FILTER (afi = 4) AS v4, count(*) FILTER (afi = 6) AS v6 FROM ever JOIN named USING (event, prefix) GROUP BY ALL),
p AS (SELECT event, slot, count(*) FILTER (class = 'normal') AS a, count(*) FILTER (class = 'partially_interrupted') AS b, count(*) FILTER (class = 'completely_interrupted') AS c, sum(visible) AS d, sum(expected) AS e FROM classed GROUP BY ALL),
s AS (SELECT event, slot, count(*) FILTER (class = 'normal') AS a, count(*) FILTER (class = 'affected') AS b, count(*) FILTER (class = 'route_interrupted') AS c FROM asns GROUP BY ALL)
SELECT g.event, g.slot, coalesce(p.a, 0) AS prefix_normal, coalesce(p.b, 0) AS prefix_partial, coalesce(p.c, 0) AS prefix_complete, coalesce(p.d, 0)::BIGINT AS prefix_visible_directions, coalesce(p.e, 0)::BIGINT AS prefix_expected_directions,
       coalesce(s.a, 0) AS asn_normal, coalesce(s.b, 0) AS asn_affected, coalesce(s.c, 0) AS asn_interrupted, coalesce(n.v4, 0) AS new_v4_prefixes, coalesce(n.v6, 0) AS new_v6_prefixes,
       coalesce(e.v4, 0) AS ever_v4_prefixes, coalesce(e.v6, 0) AS ever_v6_prefixes, coalesce(f.addresses, 0)::BIGINT AS fixed_addresses, coalesce(f.blocks_48, 0)::BIGINT AS fixed_blocks_48,
       coalesce(nc.addresses, 0)::BIGINT AS new_addresses, coalesce(nc.blocks_48, 0)::BIGINT AS new_blocks_48, coalesce(ec.addresses, 0)::BIGINT AS ever_addresses, coalesce(ec.blocks_48, 0)::BIGINT AS ever_blocks_48
FROM (SELECT event, unnest(range(cohort_slot, {LAST_SLOT + 1})) AS slot FROM events) g LEFT JOIN p USING (event, slot) LEFT JOIN s USING (event, slot) LEFT JOIN news n USING (event, slot) LEFT JOIN evers e USING (event, slot)
LEFT JOIN fixed_cover f USING (event, slot) LEFT JOIN new_cover nc USING (event, slot) LEFT JOIN ever_cover ec USING (event, slot)""",
)
def event_series(spark, sf_dir):
    rows = states(spark, sf_dir)
    return coverage.event_series(rows, cohorts(rows), origins(rows))


def query_sql(name: str) -> str:
    """The SQL of a query of this module, to build another's on."""
    return SQL[name]


def classed(spark, sf_dir):
    rows = states(spark, sf_dir)
    members, _ = coverage.cohort(rows, cohorts(rows))
    return coverage.stored(coverage.prefix_classes(members)), origins(rows), cohorts(rows)


@query(
    "concurrent_losses",
    f"""WITH {COHORT_SQL},
related AS (SELECT o.event, 3000 + (o.prefix // 3) % 20 AS affected, o.asn AS downstream, o.prefix FROM origins o WHERE o.asn <> 3000 + (o.prefix // 3) % 20),
lost AS (SELECT r.event, r.affected, r.downstream, c.slot, c.prefix FROM related r JOIN classed c USING (event, prefix) WHERE c.class <> 'normal'),
hit AS (SELECT l.* FROM lost l JOIN asns a ON a.event = l.event AND a.asn = l.affected AND a.slot = l.slot WHERE a.class <> 'normal'),
sized AS (
  SELECT h.event, h.affected, h.downstream, h.slot, count(*) AS prefixes, coalesce(sum(n.size) FILTER (n.afi = 4 AND top), 0) AS addresses, coalesce(sum(n.size) FILTER (n.afi = 6 AND top), 0) AS blocks_48
  FROM (SELECT h.*, NOT EXISTS (
          SELECT 1 FROM hit x JOIN named m ON x.prefix = m.prefix JOIN named n ON n.prefix = h.prefix
          WHERE x.event = h.event AND x.affected = h.affected AND x.downstream = h.downstream AND x.slot = h.slot AND m.afi = n.afi AND m.length < n.length AND m.network <= n.network AND m.network + m.size >= n.network + n.size) AS top FROM hit h) h
  JOIN named n ON n.prefix = h.prefix GROUP BY ALL),
found AS (SELECT event, affected, downstream, count(*) AS slots, min(slot) AS first_slot, max(slot) AS last_slot, max(prefixes) AS peak_prefixes, max(addresses) AS peak_addresses, max(blocks_48) AS peak_blocks_48 FROM sized GROUP BY ALL)
SELECT r.event, r.affected, r.downstream, r.pair_prefixes, coalesce(slots, 0) AS slots, first_slot, last_slot, coalesce(peak_prefixes, 0) AS peak_prefixes, coalesce(peak_addresses, 0)::BIGINT AS peak_addresses, coalesce(peak_blocks_48, 0)::BIGINT AS peak_blocks_48
FROM (SELECT event, affected, downstream, count(DISTINCT prefix) AS pair_prefixes FROM related GROUP BY ALL) r LEFT JOIN found USING (event, affected, downstream)""",
)
def concurrent_losses(spark, sf_dir):
    rows, own, ends = classed(spark, sf_dir)
    related = own.select("event", F.expr("3000 + (prefix div 3) % 20").alias("affected"), F.col("asn").alias("downstream"), "prefix").filter("affected <> downstream")
    return concurrency.concurrent_losses(rows, related, own, ends)


@query(
    "affected_ases",
    f"""WITH {COHORT_SQL}
SELECT event, asn, CASE WHEN count(*) FILTER (class = 'route_interrupted') > 0 THEN 'route_interrupted' ELSE 'affected' END AS event_class, max(partial) AS peak_partial, max(complete) AS peak_complete, max(invisible)::BIGINT AS peak_invisible
FROM asns GROUP BY event, asn HAVING count(*) FILTER (class <> 'normal') > 0""",
)
def affected_ases(spark, sf_dir):
    rows, own, _ = classed(spark, sf_dir)
    return concurrency.affected_ases(rows, own)


@query(
    "feature_rows",
    f"""WITH {STATE_SQL},
timed AS (SELECT *, prefix_id AS p, (epoch_s - {FIRST_S}) // {SLOT_S} AS s FROM route),
owned AS (SELECT *, coalesce(origin, last_value(origin IGNORE NULLS) OVER (PARTITION BY vp, p ORDER BY epoch_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS asn FROM timed),
updates AS (
  SELECT unnest([{{'level': 'asn', 'subject': asn::VARCHAR}}, {{'level': 'country', 'subject': CASE WHEN asn % 9 <> 4 THEN 'country ' || (asn % 7) ELSE 'unknown' END}}, {{'level': 'collector', 'subject': 'all'}}]) AS x, s AS slot, action FROM owned WHERE asn IS NOT NULL),
counts AS (SELECT x.level AS level, x.subject AS subject, slot, count(*) FILTER (action = 'announce') AS announces, count(*) FILTER (action = 'withdraw') AS withdraws FROM updates GROUP BY ALL),
last AS (SELECT vp, p, s AS slot, (array_agg(CASE WHEN action <> 'withdraw' THEN origin END ORDER BY epoch_s DESC, event_id DESC))[1] AS now FROM timed GROUP BY ALL),
cells AS (SELECT vp, p, t AS slot FROM (SELECT DISTINCT vp, p FROM timed), range(0, {LAST_SLOT + 1}) r(t)),
held AS (SELECT DISTINCT c.slot, c.p, l.now AS asn FROM cells c ASOF JOIN last l ON c.vp = l.vp AND c.p = l.p AND c.slot >= l.slot WHERE l.now IS NOT NULL),
leveled AS (
  SELECT slot, p, unnest([{{'level': 'asn', 'subject': asn::VARCHAR}}, {{'level': 'country', 'subject': CASE WHEN asn % 9 <> 4 THEN 'country ' || (asn % 7) ELSE 'unknown' END}}, {{'level': 'collector', 'subject': 'all'}}]) AS x FROM held),
blocks AS (
  SELECT DISTINCT x.level AS level, x.subject AS subject, slot, afi, unnest(CASE WHEN afi = 4 THEN range(network // 256, (network + size) // 256) ELSE range(network, network + size) END) AS block FROM leveled JOIN named ON prefix = p),
reach AS (SELECT level, subject, slot, count(*) FILTER (afi = 4) AS b24, count(*) FILTER (afi = 6) AS b48 FROM blocks GROUP BY ALL)
SELECT level, subject, slot, announces, withdraws, coalesce(b24, 0) AS blocks_24, coalesce(b24, 0) * 256 AS addresses, coalesce(b48, 0) AS blocks_48 FROM counts LEFT JOIN reach USING (level, subject, slot)""",
)
def feature_rows(spark, sf_dir):
    rows = prefixes(B.route_events(spark, sf_dir).withColumn("slot", F.expr(f"(epoch_s - {FIRST_S}) div {SLOT_S}")))
    asns = rows.select(F.col("origin").alias("asn")).filter("asn IS NOT NULL").distinct()
    countries = asns.filter("asn % 9 <> 4").select("asn", F.concat(F.lit("country "), F.col("asn") % 7).alias("country"))
    return resources.feature_rows(rows, countries, ["vp", "prefix_id"], ["epoch_s", "event_id"])
