"""Queries over frozen populations, snapshot resources, IPv6 coverage and sub-prefix hijacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prefixes
from ..operators import country, features, intervals, state, subprefix
from . import bindings as B
from .registry import query
from .series_queries import FULL, GRID, HOURLY, filled, ratios

#: Routes before it are the seed snapshot.
SEED_S = 1_704_672_000
ORDER, KEY = ["epoch_s", "event_id"], ["vp", "prefix_id"]


def family(df):
    """Every third prefix counts as IPv6, every fifth origin as unresolved."""
    origin_state = F.when(F.col("prefix_id") % 5 == 0, "unknown").when(F.col("prefix_id") % 7 == 0, "conflict").otherwise("resolved")
    return df.withColumns({"afi": F.when(F.col("prefix_id") % 3 == 0, 6).otherwise(4), "origin_state": origin_state})


def seed(spark, sf_dir):
    return family(state.replay(B.route_events(spark, sf_dir).filter(F.col("epoch_s") < SEED_S), KEY, ORDER))


def membership(spark, sf_dir):
    n = B.read(spark, sf_dir, "nation")
    return n.select((F.col("n_nationkey") + 3000).alias("asn"), F.when(F.col("n_regionkey") != 3, F.col("n_regionkey") < 3).alias("member"))


def daily_routes(spark, sf_dir):
    """Routes that hold at the start of each day from the seed on."""
    events = B.route_events(spark, sf_dir)
    days = events.filter(F.col("epoch_s") >= SEED_S).select((F.col("epoch_s") - F.col("epoch_s") % 86400).alias("slot")).distinct()
    shown = state.visible_at(state.visibility(events, KEY, ORDER, "epoch_s", ["prefix", "origin"]), days)
    return family(shown).select("slot", "vp", "afi", "prefix", "origin")


SEED_SQL = f"""{B.ROUTE_SQL},
member AS (SELECT 3000 + n_nationkey AS asn, CASE WHEN n_regionkey <> 3 THEN n_regionkey < 3 END AS member FROM nation),
seed AS (SELECT vp, prefix, origin, CASE WHEN prefix_id % 3 = 0 THEN 6 ELSE 4 END AS afi, CASE WHEN prefix_id % 5 = 0 THEN 'unknown' WHEN prefix_id % 7 = 0 THEN 'conflict' ELSE 'resolved' END AS origin_state
  FROM (SELECT *, row_number() OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s DESC, event_id DESC) AS rn FROM route WHERE epoch_s < {SEED_S}) WHERE rn = 1 AND action <> 'withdraw'),
cohort AS (SELECT vp, afi, prefix, origin FROM seed JOIN member ON asn = origin AND member WHERE origin_state = 'resolved'),
nexts AS (SELECT *, lead(epoch_s) OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s, event_id) AS to_at FROM route),
days AS (SELECT DISTINCT epoch_s - epoch_s % 86400 AS slot FROM route WHERE epoch_s >= {SEED_S}),
now AS (SELECT d.slot, vp, prefix, origin, CASE WHEN prefix_id % 3 = 0 THEN 6 ELSE 4 END AS afi FROM nexts n JOIN days d ON n.epoch_s <= d.slot AND (n.to_at IS NULL OR n.to_at > d.slot) WHERE n.action <> 'withdraw')"""


@query(
    "cohort_quality",
    f"""WITH {SEED_SQL} SELECT count(*) FILTER (origin_state = 'resolved' AND member) AS members, count(*) FILTER (origin_state = 'unknown') AS unknown_origin, count(*) FILTER (origin_state = 'conflict') AS conflict_origin,
  count(*) FILTER (origin_state = 'resolved' AND asn IS NOT NULL AND member IS NULL) AS mapping_unknown, count(*) FILTER (origin_state = 'resolved' AND (asn IS NULL OR member = false)) AS non_target FROM seed LEFT JOIN member ON asn = origin""",
)
def cohort_quality(spark, sf_dir):
    return country.cohort_quality(seed(spark, sf_dir), membership(spark, sf_dir))


@query("cohort_sizes", f"WITH {SEED_SQL} SELECT origin, afi, count(*) AS routes, count(DISTINCT prefix) AS prefixes FROM cohort GROUP BY ALL")
def cohort_sizes(spark, sf_dir):
    return country.cohort_sizes(country.freeze_cohort(seed(spark, sf_dir), membership(spark, sf_dir)))


@query(
    "country_observations",
    f"""WITH {SEED_SQL}, sizes AS (SELECT origin, afi, count(*) AS routes FROM cohort GROUP BY ALL),
seen AS (SELECT slot, c.origin, c.afi, count(*) AS visible FROM now n JOIN cohort c ON n.vp = c.vp AND n.afi = c.afi AND n.prefix = c.prefix AND n.origin = c.origin GROUP BY ALL),
cells AS (SELECT d.slot, s.origin, s.afi, s.routes, coalesce(visible, 0) AS visible FROM sizes s CROSS JOIN (SELECT DISTINCT slot FROM now) d LEFT JOIN seen e ON e.slot = d.slot AND e.origin = s.origin AND e.afi = s.afi),
own AS (SELECT slot, origin, bool_and(visible = routes) AS f, bool_and(visible = 0) AS n, sum(routes) AS routes, sum(visible) AS visible, bool_or(afi = 4 AND visible = 0) AND bool_or(afi = 6 AND visible > 0) AS six FROM cells GROUP BY ALL),
sums AS (SELECT slot, count(*) AS b, count(*) FILTER (f) AS f, count(*) FILTER (n) AS n, count(*) FILTER (NOT f AND NOT n) AS p, count(*) FILTER (six) AS six, sum(routes)::BIGINT AS r, sum(visible)::BIGINT AS v, (slot // 86400) % 7 <> 3 AS ok FROM own GROUP BY slot)
SELECT slot, b AS baseline_asns, r AS baseline_routes, CASE WHEN ok THEN f END AS fully_visible, CASE WHEN ok THEN p END AS partially_visible, CASE WHEN ok THEN n END AS fully_invisible, CASE WHEN ok THEN six END AS only_v6, CASE WHEN ok THEN v END AS visible_routes,
  CASE WHEN ok THEN (p + n) / b END AS affected_ratio, CASE WHEN ok THEN (p + f) / b END AS visible_ratio, CASE WHEN ok THEN v / r END AS route_ratio, CASE WHEN NOT ok THEN 'input_gap' END AS reason FROM sums""",
)
def country_observations(spark, sf_dir):
    cohort, now = country.freeze_cohort(seed(spark, sf_dir), membership(spark, sf_dir)), daily_routes(spark, sf_dir)
    continuity = now.select("slot").distinct().withColumn("continuous", F.floor(F.col("slot") / 86400) % 7 != 3)
    return country.observations(country.member_classes(cohort, now), continuity)


@query(
    "dynamic_members",
    f"WITH {SEED_SQL} SELECT slot, afi, count(DISTINCT origin) AS asns, count(DISTINCT prefix) AS prefixes FROM now JOIN member ON asn = origin AND member WHERE origin NOT IN (SELECT origin FROM cohort) GROUP BY ALL",
)
def dynamic_members(spark, sf_dir):
    members = membership(spark, sf_dir)
    return country.dynamic_members(country.freeze_cohort(seed(spark, sf_dir), members), daily_routes(spark, sf_dir), members)


@query(
    "growing_members",
    f"""WITH {SEED_SQL}, both_sides AS (SELECT origin, afi, prefix, {SEED_S} AS seen_s FROM cohort UNION ALL SELECT origin, CASE WHEN prefix_id % 3 = 0 THEN 6 ELSE 4 END, prefix, epoch_s FROM route JOIN member ON asn = origin AND member WHERE epoch_s >= {SEED_S})
SELECT origin, afi, prefix, min(seen_s) AS first_seen FROM both_sides GROUP BY ALL""",
)
def growing_members(spark, sf_dir):
    members = membership(spark, sf_dir)
    later = family(B.route_events(spark, sf_dir).filter(F.col("epoch_s") >= SEED_S)).join(members.filter("member").select(F.col("asn").alias("origin")), "origin")
    return country.growing_members(country.freeze_cohort(seed(spark, sf_dir), members), later, ["origin", "afi", "prefix"], "epoch_s", SEED_S)


@query(
    "resource_counts",
    f"""WITH {B.ROUTE_SQL}, r AS (SELECT *, epoch_s - epoch_s % 86400 AS day FROM route), b AS (SELECT *, 'global' AS bucket FROM r UNION ALL SELECT *, vp::VARCHAR FROM r WHERE vp IN (100, 101)),
h AS (SELECT day, bucket, unnest(string_split(as_path, ' '))::BIGINT AS asn FROM b WHERE as_path IS NOT NULL),
n AS (SELECT day, bucket, count(DISTINCT asn) FILTER (asn BETWEEN 64512 AND 65535) AS private_asn, count(DISTINCT asn) FILTER (asn NOT BETWEEN 64512 AND 65535) AS public_asn FROM h GROUP BY ALL)
SELECT day, bucket, count(DISTINCT prefix) AS prefix, count(DISTINCT vp) AS vp, count(DISTINCT as_path) AS path, coalesce(any_value(private_asn), 0) AS private_asn, coalesce(any_value(public_asn), 0) AS public_asn FROM b LEFT JOIN n USING (day, bucket) GROUP BY day, bucket""",
)
def resource_counts(spark, sf_dir):
    rows = B.route_events(spark, sf_dir).withColumn("day", F.col("epoch_s") - F.col("epoch_s") % 86400)
    hops = F.coalesce(F.split("as_path", " "), F.array().cast("array<string>"))
    private = lambda h: h.cast("bigint").between(64512, 65535)
    kinds = {"prefix": F.array("prefix"), "vp": F.array("vp"), "path": F.array("as_path"), "private_asn": F.filter(hops, private), "public_asn": F.filter(hops, lambda h: ~private(h))}
    return features.resource_counts(rows, "day", "vp", [100, 101], kinds)


@query(
    "vp_resources",
    f"WITH {B.ROUTE_SQL}, c AS (SELECT epoch_s - epoch_s % 86400 AS day, vp, count(DISTINCT prefix) AS prefixes FROM route GROUP BY ALL) SELECT day, vp, coalesce(s_name, '') AS as_name, s_nationkey AS as_rank, prefixes FROM c LEFT JOIN supplier ON s_suppkey = vp - 98",
)
def vp_resources(spark, sf_dir):
    rows = B.route_events(spark, sf_dir).withColumn("day", F.col("epoch_s") - F.col("epoch_s") % 86400)
    names = B.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 98).alias("asn"), F.col("s_name").alias("as_name"), F.col("s_nationkey").alias("as_rank"))
    return features.vp_resources(rows, "day", "vp", names)


@query(
    "covered_blocks_48",
    f"""WITH {B.ROUTE_SQL}, p AS (SELECT vp, prefix_id * 4 % 65536 AS g, 44 + event_id % 7 AS n FROM route), b AS (SELECT vp, g - g % (1 << greatest(48 - n, 0)::INT) AS base, (1 << greatest(48 - n, 0)::INT) AS size FROM p),
x AS (SELECT vp, unnest(range(base, base + size)) AS block FROM b) SELECT vp, count(DISTINCT block) AS blocks FROM x GROUP BY vp""",
)
def covered_blocks_48(spark, sf_dir):
    """Prefixes of 44 to 50 bits with host bits set, that overlap."""
    text = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("prefix_id") * 4 % 65536)), F.lit("::1/"), (F.lit(44) + F.col("event_id") % 7).cast("string"))
    return intervals.v6_blocks_48(B.route_events(spark, sf_dir).select("vp", text.alias("p")), ["vp"], "p")


def nested_routes(spark, sf_dir):
    """Prefixes of parts inside those of suppliers."""
    s, part = (F.col("s_suppkey") * 65536) % (1 << 32), B.read(spark, sf_dir, "part")
    size = F.element_at(F.array(F.lit(1 << 16), F.lit(1 << 17), F.lit(1 << 18)), (F.col("s_suppkey") % 3 + 1).cast("int")).cast("bigint")
    parents = B.read(spark, sf_dir, "supplier").select((s - s % size).alias("network"), (16 - F.col("s_suppkey") % 3).cast("int").alias("length"), F.col("s_nationkey").cast("bigint").alias("origin"))
    own = part.select((F.col("p_partkey") * 1024 % (1 << 32)).alias("network"), F.lit(22).alias("length"), (F.col("p_size") % 30).cast("bigint").alias("origin"))
    deep = part.filter("p_retailprice > 1400").select((F.col("p_partkey") * 1024 % (1 << 32)).alias("network"), F.lit(26).alias("length"), (F.col("p_size") % 29).cast("bigint"))
    return parents.union(own).union(deep)


NESTED_SQL = """r AS (SELECT (s_suppkey * 65536) % 4294967296 - ((s_suppkey * 65536) % 4294967296) % (1 << (16 + (s_suppkey % 3)::INT)) AS network, (16 - s_suppkey % 3)::INT AS length, s_nationkey::BIGINT AS origin FROM supplier
  UNION ALL SELECT (p_partkey * 1024) % 4294967296, 22, p_size % 30 FROM part UNION ALL SELECT (p_partkey * 1024) % 4294967296, 26, p_size % 29 FROM part WHERE p_retailprice > 1400),
sets AS (SELECT network, length, list_sort(list(DISTINCT origin)) AS o FROM r GROUP BY ALL),
met AS (SELECT c.*, p.network AS pn, p.length AS pl, p.o AS po, row_number() OVER (PARTITION BY c.network, c.length ORDER BY p.length DESC) AS rn FROM sets c JOIN sets p ON p.length < c.length AND c.network - c.network % (1::BIGINT << (32 - p.length)) = p.network),
states AS (SELECT *, list_filter(o, lambda x: NOT list_contains(po, x)) AS fresh, CASE WHEN length - pl > 8 THEN 'prefix length difference is too large' WHEN len(list_filter(o, lambda x: NOT list_contains(po, x))) = 0 THEN 'same origins' WHEN len(po) > 1 THEN 'parent origin as num more than 1' END AS reason FROM met WHERE rn = 1)"""


@query("sub_prefix_states", f"WITH {NESTED_SQL} SELECT network, length, pn AS parent_network, pl AS parent_length, array_to_string(fresh, ',') AS new_origins, reason FROM states")
def sub_prefix_states(spark, sf_dir):
    out = subprefix.sub_prefix_states(nested_routes(spark, sf_dir))
    return out.select("network", "length", "parent_network", "parent_length", F.array_join(F.sort_array(F.col("new_origins")).cast("array<string>"), ",").alias("new_origins"), "reason")


@query(
    "sub_hijack_filter",
    f"""WITH {NESTED_SQL}, reg AS (SELECT (p_partkey * 1024) % 4294967296 AS network, 22 AS length, list(DISTINCT (p_partkey % 25)::BIGINT) AS more FROM part WHERE p_size < 10 GROUP BY ALL),
w AS (SELECT s.network, s.length, unnest(fresh) AS suspect, po[1] AS owner, coalesce(more, []) AS more FROM states s LEFT JOIN reg USING (network, length) WHERE reason IS NULL),
pairs AS (SELECT network, length, suspect, owner, unnest(list_distinct(list_concat([suspect], more))) AS a, owner AS b FROM w),
e AS (SELECT DISTINCT l_suppkey % 30 AS a, l_partkey % 30 AS b, (l_quantity - 48)::INT AS rel FROM lineitem WHERE l_quantity BETWEEN 47 AND 49 AND l_linenumber = 1),
m AS (SELECT a, b, rel FROM e UNION ALL SELECT b, a, -rel FROM e), rel AS (SELECT a, b, min(CASE rel WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS p FROM m GROUP BY a, b),
pol AS (SELECT DISTINCT l_suppkey % 30 AS a, l_partkey % 30 AS b FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1), both_ways AS (SELECT a, b FROM pol UNION SELECT b, a FROM pol),
x AS (SELECT q.*, CASE WHEN (q.a, q.b) IN (SELECT (a, b) FROM both_ways) THEN 2 WHEN p > 0 THEN 3 WHEN p = 0 THEN 4 WHEN q.a = q.b OR na.n_regionkey = nb.n_regionkey THEN 5 WHEN q.a IN (SELECT s_suppkey % 30 FROM supplier WHERE s_acctbal > 9000) OR q.b IN (SELECT s_suppkey % 30 FROM supplier WHERE s_acctbal > 9000) THEN 6 END AS k
  FROM pairs q LEFT JOIN rel ON rel.a = q.a AND rel.b = q.b LEFT JOIN nation na ON na.n_nationkey = q.a LEFT JOIN nation nb ON nb.n_nationkey = q.b)
SELECT network, length, suspect, owner, CASE min(k) WHEN 2 THEN 'policy' WHEN 3 THEN 'as rel provider-customer' WHEN 4 THEN 'as rel peer' WHEN 5 THEN 'as rel same org' WHEN 6 THEN 'is AntiDDoS provider' END AS filter_reason FROM x GROUP BY network, length, suspect, owner""",
)
def sub_hijack_filter(spark, sf_dir):
    i, part = B.read(spark, sf_dir, "lineitem").filter("l_linenumber = 1"), B.read(spark, sf_dir, "part")
    a, b = (F.col("l_suppkey") % 30).alias("a"), (F.col("l_partkey") % 30).alias("b")
    edges = i.filter("l_quantity BETWEEN 47 AND 49").select(a, b, (F.col("l_quantity") - 48).cast("int").alias("rel")).distinct()
    policies = i.filter("l_quantity = 50").select(a.alias("asn"), b.alias("other")).distinct()
    registered = part.filter("p_size < 10").select((F.col("p_partkey") * 1024 % (1 << 32)).alias("network"), F.lit(22).alias("length"), (F.col("p_partkey") % 25).alias("origin"))
    orgs = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("asn"), F.col("n_name").alias("org"), F.col("n_regionkey").cast("string").alias("org_en"))
    protectors = B.read(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select((F.col("s_suppkey") % 30).alias("asn")).distinct()
    return subprefix.cleared_pairs(subprefix.sub_prefix_states(nested_routes(spark, sf_dir)), registered, policies, edges, orgs, protectors)


@query(
    "hijack_lifecycle",
    f"""WITH {B.ROUTE_SQL}, d AS (SELECT prefix_id, epoch_s - epoch_s % 86400 AS day, count(DISTINCT origin) > 1 AS flag FROM route GROUP BY ALL),
t AS (SELECT *, coalesce(lag(flag) OVER (PARTITION BY prefix_id ORDER BY day), false) AS before FROM d), c AS (SELECT *, lead(day) OVER (PARTITION BY prefix_id ORDER BY day) AS end_at FROM t WHERE flag <> before)
SELECT prefix_id, day AS start_at, end_at FROM c WHERE flag""",
)
def hijack_lifecycle(spark, sf_dir):
    days = B.route_events(spark, sf_dir).groupBy("prefix_id", (F.col("epoch_s") - F.col("epoch_s") % 86400).alias("day")).agg((F.count_distinct("origin") > 1).alias("flag"))
    return subprefix.lifecycle(days, ["prefix_id"], "day", "flag")


@query(
    "trend_profile",
    f"""WITH {HOURLY}, {GRID}, {FULL}, p AS (SELECT asn, count(*) AS expected, count(*) FILTER (value_state <> 'not_observed') AS observed, arg_min(value_state <> 'not_observed', slot) AS start_observed, arg_max(value_state <> 'not_observed', slot) AS end_observed FROM f GROUP BY asn)
SELECT *, CASE WHEN observed = expected THEN 'complete' WHEN observed = 0 THEN 'unavailable' ELSE 'degraded' END AS status,
  concat_ws(',', CASE WHEN observed = 0 THEN 'no_observed_slots' WHEN observed < expected THEN 'non_observed_slots_present' END, CASE WHEN NOT start_observed THEN 'window_start_not_observed' END, CASE WHEN NOT end_observed THEN 'window_end_not_observed' END) AS limitations FROM p""",
)
def trend_profile(spark, sf_dir):
    rows = filled(spark, sf_dir).withColumn("state", F.when(F.col("value_state") == "not_observed", "missing").otherwise("observed"))
    return country.trend_profile(rows, ["asn"], "slot", "state")


@query("episode_waves")
def episode_waves(spark, sf_dir):
    return country.waves(ratios(spark, sf_dir).withColumn("severity", 1 - F.col("ratio")), ["asn"], "slot", "severity", 0.2)


V6_BASE = 0x20010DB8 << 32


def nested_routes_v6(spark, sf_dir):
    """IPv6 prefixes of parts inside those of suppliers, some longer than 64 bits."""
    part, base = B.read(spark, sf_dir, "part"), F.lit(V6_BASE)
    words = lambda hi, lo: F.struct(hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo"))
    parents = B.read(spark, sf_dir, "supplier").select(words(base + F.col("s_suppkey") % 50 * 65536, F.lit(0)).alias("network"), (44 + F.col("s_suppkey") % 5).cast("int").alias("length"), F.col("s_nationkey").cast("bigint").alias("origin"))
    own = part.select(words(base + F.col("p_partkey") % 60 * 65536 + F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 7).otherwise(0), F.lit(0)).alias("network"), F.element_at(F.array(F.lit(48), F.lit(50), F.lit(64)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("length"), (F.col("p_size") % 30).cast("bigint").alias("origin"))
    deep = part.filter("p_retailprice > 1400").select(words(base + F.col("p_partkey") % 60 * 65536, F.expr("shiftleft(p_partkey % 11, 60)")).alias("network"), (F.lit(66) + F.col("p_partkey") % 3).cast("int").alias("length"), (F.col("p_size") % 29).cast("bigint"))
    rows = parents.union(own).union(deep)
    return rows.withColumn("network", prefixes.v6_cut(F.col("network"), F.col("length")))


NESTED_V6_SQL = f"""raw AS (
  SELECT ({V6_BASE} + s_suppkey % 50 * 65536)::HUGEINT * 18446744073709551616 AS n, (44 + s_suppkey % 5)::INT AS length, s_nationkey::BIGINT AS origin FROM supplier
  UNION ALL SELECT ({V6_BASE} + p_partkey % 60 * 65536 + CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 7 ELSE 0 END)::HUGEINT * 18446744073709551616, [48, 50, 64][p_partkey % 3 + 1], p_size % 30 FROM part
  UNION ALL SELECT ({V6_BASE} + p_partkey % 60 * 65536)::HUGEINT * 18446744073709551616 + (p_partkey % 11)::HUGEINT * 1152921504606846976, (66 + p_partkey % 3)::INT, p_size % 29 FROM part WHERE p_retailprice > 1400),
size AS (SELECT length, list_reduce(list_prepend(1::HUGEINT, range(128 - length)::HUGEINT[]), lambda x, y: x * 2) AS size FROM (SELECT DISTINCT length FROM raw)),
r AS (SELECT n - n % size AS network, length, origin FROM raw JOIN size USING (length)),
sets AS (SELECT network, length, list_sort(list(DISTINCT origin)) AS o FROM r GROUP BY ALL),
met AS (SELECT c.*, p.network AS pn, p.length AS pl, p.o AS po, row_number() OVER (PARTITION BY c.network, c.length ORDER BY p.length DESC) AS rn FROM sets c JOIN sets p ON p.length < c.length JOIN size s ON s.length = p.length AND c.network - c.network % s.size = p.network),
states AS (SELECT *, list_filter(o, lambda x: NOT list_contains(po, x)) AS fresh, CASE WHEN length - pl > 3 THEN 'prefix length difference is too large' WHEN len(list_filter(o, lambda x: NOT list_contains(po, x))) = 0 THEN 'same origins' WHEN len(po) > 1 THEN 'parent origin as num more than 1' END AS reason FROM met WHERE rn = 1)"""


def _low(n: str) -> str:
    return f"(CASE WHEN {n} % 18446744073709551616 >= 9223372036854775808 THEN {n} % 18446744073709551616 - 18446744073709551616 ELSE {n} % 18446744073709551616 END)::BIGINT"


@query(
    "sub_prefix_states_v6",
    f"WITH {NESTED_V6_SQL} SELECT (network // 18446744073709551616)::BIGINT AS hi, {_low('network')} AS lo, length, (pn // 18446744073709551616)::BIGINT AS parent_hi, {_low('pn')} AS parent_lo, pl AS parent_length, array_to_string(fresh, ',') AS new_origins, reason FROM states",
)
def sub_prefix_states_v6(spark, sf_dir):
    out = subprefix.sub_prefix_states_v6(nested_routes_v6(spark, sf_dir))
    return out.select("network.*", "length", F.col("parent_network.hi").alias("parent_hi"), F.col("parent_network.lo").alias("parent_lo"), "parent_length", F.array_join(F.sort_array(F.col("new_origins")).cast("array<string>"), ",").alias("new_origins"), "reason")


@query(
    "sub_hijack_filter_v6",
    f"""WITH {NESTED_V6_SQL},
w AS (SELECT network, length, unnest(fresh) AS suspect, po[1] AS owner FROM states WHERE reason IS NULL),
e AS (SELECT DISTINCT l_suppkey % 30 AS a, l_partkey % 30 AS b, (l_quantity - 48)::INT AS rel FROM lineitem WHERE l_quantity BETWEEN 47 AND 49 AND l_linenumber = 1),
m AS (SELECT a, b, rel FROM e UNION ALL SELECT b, a, -rel FROM e), rel AS (SELECT a, b, min(CASE rel WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS p FROM m GROUP BY a, b),
x AS (SELECT w.*, CASE WHEN p > 0 THEN 'as rel provider-customer' WHEN p = 0 THEN 'as rel peer' WHEN na.n_regionkey = nb.n_regionkey THEN 'as rel same org' END AS filter_reason
  FROM w LEFT JOIN rel ON rel.a = w.suspect AND rel.b = w.owner LEFT JOIN nation na ON na.n_nationkey = w.suspect LEFT JOIN nation nb ON nb.n_nationkey = w.owner)
SELECT (network // 18446744073709551616)::BIGINT AS hi, {_low('network')} AS lo, length, suspect, owner, filter_reason FROM x""",
)
def sub_hijack_filter_v6(spark, sf_dir):
    i = B.read(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_quantity BETWEEN 47 AND 49")
    edges = i.select((F.col("l_suppkey") % 30).alias("a"), (F.col("l_partkey") % 30).alias("b"), (F.col("l_quantity") - 48).cast("int").alias("rel")).distinct()
    orgs = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("asn"), F.col("n_name").alias("org"), F.col("n_regionkey").cast("string").alias("org_en"))
    states = subprefix.sub_prefix_states_v6(nested_routes_v6(spark, sf_dir))
    nothing = states.select("network", "length", F.lit(0).cast("bigint").alias("origin")).limit(0)
    none = edges.select(F.col("a").alias("asn"), F.col("b").alias("other")).limit(0)
    return subprefix.cleared_pairs(states, nothing, none, edges, orgs, none.select("asn")).select("network.*", "length", "suspect", "owner", "filter_reason")
