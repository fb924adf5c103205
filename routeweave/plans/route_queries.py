"""Queries over route state, features, coverage, detection and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, graph, intervals, state
from . import bindings as B
from .registry import query

ORDER = ["epoch_s", "event_id"]
KEY = ["vp", "prefix_id"]


@query(
    "slot_features",
    f"""WITH {B.ROUTE_SQL},
last_origin AS (
  SELECT *, coalesce(origin, last_value(origin IGNORE NULLS) OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS asn FROM route)
SELECT slot, asn, count(*) FILTER (action = 'announce') AS announces, count(*) FILTER (action = 'withdraw') AS withdraws, count(DISTINCT prefix) AS prefixes
FROM last_origin WHERE asn IS NOT NULL GROUP BY slot, asn""",
)
def slot_features(spark, sf_dir):
    return features.slot_counts(B.route_events(spark, sf_dir), KEY, ORDER)


@query(
    "slot_features_levels",
    f"""WITH {B.ROUTE_SQL}
SELECT slot, vp, CASE WHEN grouping(vp) = 1 THEN 'collector' ELSE 'vp' END AS level, count(*) FILTER (action = 'announce') AS announces,
       count(*) FILTER (action = 'withdraw') AS withdraws, count(DISTINCT prefix) AS prefixes
FROM route GROUP BY GROUPING SETS ((slot, vp), (slot))""",
)
def slot_features_levels(spark, sf_dir):
    return features.level_counts(B.route_events(spark, sf_dir), "slot", "vp")


@query(
    "state_replay",
    f"""WITH {B.ROUTE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s DESC, event_id DESC) AS rn FROM route)
SELECT vp, prefix_id, event_id, epoch_s, origin, as_path FROM ranked WHERE rn = 1 AND action <> 'withdraw'""",
)
def state_replay(spark, sf_dir):
    return state.replay(B.route_events(spark, sf_dir), KEY, ORDER).select(*KEY, "event_id", "epoch_s", "origin", "as_path")


@query(
    "state_order_conflicts",
    f"""WITH {B.ROUTE_SQL} SELECT vp, epoch_s, count(*) AS n FROM route GROUP BY vp, epoch_s HAVING count(*) > 1""",
)
def state_order_conflicts(spark, sf_dir):
    return state.order_conflicts(B.route_events(spark, sf_dir), ["vp"], ["epoch_s"])


@query(
    "visibility_intervals",
    f"""WITH {B.ROUTE_SQL}, nexts AS (SELECT *, lead(epoch_s) OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s, event_id) AS to_at FROM route)
SELECT vp, prefix_id, origin, epoch_s AS from_at, to_at FROM nexts WHERE action <> 'withdraw' AND (to_at IS NULL OR to_at > epoch_s)""",
)
def visibility_intervals(spark, sf_dir):
    return state.visibility(B.route_events(spark, sf_dir), KEY, ORDER, "epoch_s", ["origin"])


DAYS_SQL = "days AS (SELECT DISTINCT epoch_s - epoch_s % 86400 AS slot FROM route)"


@query(
    "snapshot_counts",
    f"""WITH {B.ROUTE_SQL}, {DAYS_SQL}, nexts AS (SELECT *, lead(epoch_s) OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s, event_id) AS to_at FROM route)
SELECT slot, origin, count(*) AS routes, count(DISTINCT prefix_id) AS prefixes FROM
  (SELECT d.slot, n.origin, n.prefix_id FROM nexts n JOIN days d ON n.epoch_s <= d.slot AND (n.to_at IS NULL OR n.to_at > d.slot) WHERE n.action <> 'withdraw')
GROUP BY slot, origin""",
)
def snapshot_counts(spark, sf_dir):
    events = B.route_events(spark, sf_dir)
    days = events.select((F.col("epoch_s") - F.col("epoch_s") % 86400).alias("slot")).distinct()
    shown = state.slot_populations(state.visibility(events, KEY, ORDER, "epoch_s", ["origin"]), days, ["origin"], "prefix_id", 86400)
    return shown.withColumnRenamed("items", "prefixes")


RUNNING_SQL = f"""{B.ROUTE_SQL},
ups AS (SELECT *, (action <> 'withdraw')::INT AS up, coalesce(lag((action <> 'withdraw')::INT) OVER k, 0) AS before, (row_number() OVER k = 1)::INT AS fresh
        FROM route WINDOW k AS (PARTITION BY prefix_id, vp ORDER BY epoch_s, event_id)),
counts AS (SELECT prefix_id, epoch_s, event_id, sum(up - before) OVER s AS visible, sum(fresh) OVER s AS seen FROM ups WHERE up <> before OR fresh = 1
        WINDOW s AS (PARTITION BY prefix_id ORDER BY epoch_s, event_id ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT *, coalesce(last_value(CASE WHEN visible = 0 AND seen >= 3 THEN 1 WHEN visible >= 0.4 * seen THEN 0 END IGNORE NULLS)
        OVER (PARTITION BY prefix_id ORDER BY epoch_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS down FROM counts)"""


@query(
    "prefix_outages",
    f"""WITH {RUNNING_SQL},
begins AS (SELECT *, lag(down) OVER (PARTITION BY prefix_id ORDER BY epoch_s, event_id) AS prior FROM marked),
runs AS (SELECT *, lead(epoch_s) OVER (PARTITION BY prefix_id ORDER BY epoch_s, event_id) AS end_at FROM begins WHERE prior IS NULL OR prior <> down)
SELECT prefix_id, epoch_s AS start_at, end_at, CAST(seen AS BIGINT) AS seen_at_start FROM runs WHERE down = 1""",
)
def prefix_outages(spark, sf_dir):
    return state.prefix_outages(B.route_events(spark, sf_dir), ["prefix_id"], ["vp"], ORDER, "epoch_s")


@query(
    "prefix_running_counts",
    f"""WITH {RUNNING_SQL} SELECT prefix_id, epoch_s, event_id, CAST(visible AS BIGINT) AS visible, CAST(seen AS BIGINT) AS seen FROM counts""",
)
def prefix_running_counts(spark, sf_dir):
    return state.running_visible(B.route_events(spark, sf_dir), ["prefix_id"], ["vp"], ORDER, "epoch_s")


@query(
    "as_outages",
    f"""WITH {B.ROUTE_SQL}, grouped AS (SELECT *, prefix_id % 40 AS asn FROM route),
ups AS (SELECT *, (action <> 'withdraw')::INT AS up, coalesce(lag((action <> 'withdraw')::INT) OVER k, 0) AS before, (row_number() OVER k = 1)::INT AS fresh
        FROM grouped WINDOW k AS (PARTITION BY asn, vp, prefix_id ORDER BY epoch_s, event_id)),
counts AS (SELECT asn, epoch_s, event_id, sum(fresh) OVER s AS seen, sum(fresh) OVER s - sum(up - before) OVER s AS lost FROM ups WHERE up <> before OR fresh = 1
        WINDOW s AS (PARTITION BY asn ORDER BY epoch_s, event_id ROWS UNBOUNDED PRECEDING)),
ratios AS (SELECT *, lost / seen AS ratio FROM counts WHERE seen >= 5),
marked AS (SELECT *, coalesce(last_value(CASE WHEN ratio > 0.2 THEN 1 WHEN 1 - ratio > 0.85 THEN 0 END IGNORE NULLS)
        OVER (PARTITION BY asn ORDER BY epoch_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS down FROM ratios),
fresh AS (SELECT *, (down = 1 AND coalesce(lag(down) OVER w, 0) = 0)::INT AS f, lead(epoch_s) OVER w AS after FROM marked WINDOW w AS (PARTITION BY asn ORDER BY epoch_s, event_id)),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY asn ORDER BY epoch_s, event_id ROWS UNBOUNDED PRECEDING) AS outage FROM fresh)
SELECT asn, CAST(outage AS BIGINT) AS outage, min(epoch_s) AS start_at, (array_agg(after ORDER BY epoch_s DESC, event_id DESC))[1] AS end_at, CAST(max(lost) AS BIGINT) AS peak_lost,
       max(ratio) AS peak_ratio, (array_agg(epoch_s ORDER BY ratio DESC, epoch_s))[1] AS peak_at
FROM numbered WHERE down = 1 GROUP BY asn, outage""",
)
def as_outages(spark, sf_dir):
    events = B.route_events(spark, sf_dir).withColumn("asn", F.col("prefix_id") % 40)
    counts = state.running_visible(events, ["asn"], ["vp", "prefix_id"], ORDER, "epoch_s").filter("seen >= 5")
    counts = counts.withColumn("lost", F.col("seen") - F.col("visible"))
    return state.ratio_outages(counts, ["asn"], ORDER, "epoch_s", "lost", "seen")


MOAS_SQL = f"""{B.ROUTE_SQL},
was AS (SELECT *, lag(origin) OVER (PARTITION BY prefix_id, vp ORDER BY epoch_s, event_id) AS w FROM route),
changes AS (SELECT prefix_id, epoch_s, event_id, w AS o, -1 AS d FROM was WHERE w IS DISTINCT FROM origin AND w IS NOT NULL
            UNION ALL SELECT prefix_id, epoch_s, event_id, origin, 1 FROM was WHERE w IS DISTINCT FROM origin AND origin IS NOT NULL),
routes AS (SELECT *, sum(d) OVER (PARTITION BY prefix_id, o ORDER BY epoch_s, event_id, d ROWS UNBOUNDED PRECEDING) AS r FROM changes),
turns AS (SELECT prefix_id, epoch_s, event_id, sum(CASE WHEN d = 1 THEN 1 ELSE -1 END) AS turn FROM routes WHERE (d = 1 AND r = 1) OR (d = -1 AND r = 0) GROUP BY ALL),
sets AS (SELECT prefix_id, epoch_s, event_id, sum(turn) OVER (PARTITION BY prefix_id ORDER BY epoch_s, event_id ROWS UNBOUNDED PRECEDING) AS origins FROM turns)"""


@query("origin_set_sizes", f"WITH {MOAS_SQL} SELECT prefix_id, epoch_s, event_id, CAST(origins AS BIGINT) AS origins FROM sets")
def origin_set_sizes(spark, sf_dir):
    return state.origin_sets(B.route_events(spark, sf_dir), ["prefix_id"], ORDER, "epoch_s", "origin", ["vp"])


@query(
    "moas_events",
    f"""WITH {MOAS_SQL},
fresh AS (SELECT *, (origins > 1)::INT AS several, (origins > 1 AND coalesce(lag((origins > 1)::INT) OVER w, 0) = 0)::INT AS f, lead(epoch_s) OVER w AS after
          FROM sets WINDOW w AS (PARTITION BY prefix_id ORDER BY epoch_s, event_id)),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY prefix_id ORDER BY epoch_s, event_id ROWS UNBOUNDED PRECEDING) AS number FROM fresh)
SELECT prefix_id, CAST(number AS BIGINT) AS number, min(epoch_s) AS start_at, (array_agg(after ORDER BY epoch_s DESC, event_id DESC))[1] AS end_at, CAST(max(origins) AS BIGINT) AS most_origins
FROM numbered WHERE several = 1 GROUP BY prefix_id, number""",
)
def moas_events(spark, sf_dir):
    return state.moas_events(B.route_events(spark, sf_dir), ["prefix_id"], ORDER, "epoch_s", "origin", ["vp"])


@query(
    "origin_relation",
    f"""WITH {B.ROUTE_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s DESC, event_id DESC) AS rn FROM route)
SELECT prefix_id, count(DISTINCT vp) AS n_vps, count(DISTINCT origin) AS n_origins, min(origin) AS first_origin, count(DISTINCT origin) > 1 AS moas
FROM ranked WHERE rn = 1 AND action <> 'withdraw' GROUP BY prefix_id""",
)
def origin_relation(spark, sf_dir):
    return features.origin_relation(state.replay(B.route_events(spark, sf_dir), KEY, ORDER), ["prefix_id"])


@query(
    "route_metrics_running",
    f"""WITH {B.ROUTE_SQL},
ups AS (SELECT *, (action <> 'withdraw')::INT - coalesce(lag((action <> 'withdraw')::INT) OVER (PARTITION BY vp, prefix_id ORDER BY epoch_s, event_id), 0) AS change FROM route),
slots AS (SELECT vp, slot, sum(change) AS change, count(*) FILTER (action = 'announce') AS announces, count(*) FILTER (action = 'withdraw') AS withdraws FROM ups GROUP BY vp, slot)
SELECT vp, slot, announces, withdraws, CAST(sum(change) OVER (PARTITION BY vp ORDER BY slot ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visible FROM slots""",
)
def route_metrics_running(spark, sf_dir):
    return features.running_metrics(B.route_events(spark, sf_dir), ["vp"], KEY, ORDER, "slot")


NETS = "CAST(split_part(prefix, '.', 2) AS BIGINT) * 256 + CAST(split_part(prefix, '.', 3) AS BIGINT)"


@query(
    "covered_blocks_24",
    f"WITH {B.ROUTE_SQL} SELECT origin, count(DISTINCT {NETS}) AS blocks FROM route WHERE origin IS NOT NULL GROUP BY origin",
)
def covered_blocks_24(spark, sf_dir):
    return intervals.v4_blocks(B.route_events(spark, sf_dir).filter("origin IS NOT NULL"), ["origin"], "prefix")


@query(
    "covered_addresses",
    f"WITH {B.ROUTE_SQL} SELECT vp, 256 * count(DISTINCT {NETS}) AS addresses, count(DISTINCT {NETS})::DOUBLE AS equivalent_24 FROM route WHERE origin IS NOT NULL GROUP BY vp",
)
def covered_addresses(spark, sf_dir):
    return intervals.v4_addresses(B.route_events(spark, sf_dir).filter("origin IS NOT NULL"), ["vp"], "prefix")


@query(
    "covering_prefix",
    """WITH nets AS (SELECT DISTINCT p_partkey AS id, (p_partkey * 1024) % 4294967296 AS network, 22 AS length FROM part),
parents AS (SELECT DISTINCT (s_suppkey * 65536) % 4294967296 - ((s_suppkey * 65536) % 4294967296) % (1 << (16 + (s_suppkey % 3)::INT)) AS network, (16 - s_suppkey % 3)::INT AS length FROM supplier),
met AS (SELECT n.id, p.network, p.length, row_number() OVER (PARTITION BY n.id ORDER BY p.length DESC, p.network) AS rn
        FROM nets n JOIN parents p ON p.length < n.length AND n.network - n.network % (1::BIGINT << (32 - p.length)) = p.network)
SELECT id, network AS parent_network, length AS parent_length FROM met WHERE rn = 1""",
)
def covering_prefix(spark, sf_dir):
    nets = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 1024 % (1 << 32)).alias("network"), F.lit(22).alias("length")).distinct()
    s = (F.col("s_suppkey") * 65536) % (1 << 32)
    size = F.element_at(F.array(F.lit(1 << 16), F.lit(1 << 17), F.lit(1 << 18)), (F.col("s_suppkey") % 3 + 1).cast("int")).cast("bigint")
    parents = B.read(spark, sf_dir, "supplier").select((s - s % size).alias("network"), (16 - F.col("s_suppkey") % 3).cast("int").alias("length")).distinct()
    return features.nearest_covering(nets, parents, "id")


@query(
    "adjacency",
    f"""WITH {B.PATH_SQL}, hops AS (SELECT path_id, unnest(string_split(as_path, ' '))::BIGINT AS h, unnest(range(len(string_split(as_path, ' ')))) AS i FROM path),
pairs AS (SELECT a.h AS x, b.h AS y FROM hops a JOIN hops b ON a.path_id = b.path_id AND b.i = a.i + 1 WHERE a.h <> b.h)
SELECT least(x, y) AS low, greatest(x, y) AS high, count(*) AS n_paths FROM pairs GROUP BY ALL""",
)
def adjacency(spark, sf_dir):
    return graph.adjacency(B.paths(spark, sf_dir))


EDGES_SQL = f"""{B.PATH_SQL}, hops AS (SELECT path_id, unnest(string_split(as_path, ' '))::BIGINT AS h, unnest(range(len(string_split(as_path, ' ')))) AS i FROM path),
edges AS (SELECT least(a.h, b.h) AS low, greatest(a.h, b.h) AS high, count(*) AS n_paths FROM hops a JOIN hops b ON a.path_id = b.path_id AND b.i = a.i + 1 WHERE a.h <> b.h GROUP BY ALL)"""


@query(
    "country_topology",
    f"""WITH {EDGES_SQL}
SELECT n.n_name AS country, low, high, n_paths FROM edges JOIN supplier a ON a.s_suppkey = low JOIN supplier b ON b.s_suppkey = high AND a.s_nationkey = b.s_nationkey JOIN nation n ON n.n_nationkey = a.s_nationkey""",
)
def country_topology(spark, sf_dir):
    places = B.read(spark, sf_dir, "supplier").join(B.read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("asn"), F.col("n_name").alias("country"))
    return graph.inside_country(graph.adjacency(B.paths(spark, sf_dir)), places)


MAX_NODES, MAX_EDGES = 60, 400


def _hop_sql(k: int) -> str:
    """Step ``k`` of a capped subgraph: edges in order, as far as both caps allow."""
    done = " UNION ALL ".join(f"SELECT low, high FROM step{j}" for j in range(1, k)) or "SELECT NULL::BIGINT AS low, NULL::BIGINT AS high WHERE false"
    return f"""
done{k} AS ({done}),
near{k} AS (SELECT *, row_number() OVER (ORDER BY n_paths DESC, low, high) AS r FROM (
  SELECT * FROM edges e WHERE (low IN (SELECT node FROM front{k - 1}) OR high IN (SELECT node FROM front{k - 1})) AND NOT EXISTS (SELECT 1 FROM done{k} d WHERE d.low = e.low AND d.high = e.high))),
first{k} AS (SELECT r, row_number() OVER (ORDER BY r) AS i FROM (
  SELECT node, min(r) AS r FROM (SELECT r, low AS node FROM near{k} UNION ALL SELECT r, high FROM near{k}) WHERE node NOT IN (SELECT node FROM reached{k - 1}) GROUP BY node)),
step{k} AS (
  SELECT low, high, n_paths, {k} AS hop FROM near{k} WHERE r <= {MAX_EDGES} - (SELECT count(*) FROM done{k}) AND r <= coalesce((SELECT r FROM first{k} WHERE i = {MAX_NODES} - (SELECT count(*) FROM reached{k - 1})), 1000000000)
  AND (SELECT count(*) FROM done{k}) < {MAX_EDGES} AND (SELECT count(*) FROM reached{k - 1}) < {MAX_NODES}),
front{k} AS (SELECT DISTINCT node FROM (SELECT low AS node FROM step{k} UNION ALL SELECT high FROM step{k}) WHERE node NOT IN (SELECT node FROM reached{k - 1})),
reached{k} AS (SELECT node FROM reached{k - 1} UNION SELECT node FROM front{k})"""


@query(
    "capped_subgraph",
    f"""WITH {EDGES_SQL}, front0 AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < -800), reached0 AS (SELECT * FROM front0), {_hop_sql(1)}, {_hop_sql(2)}, {_hop_sql(3)}
SELECT * FROM step1 UNION ALL SELECT * FROM step2 UNION ALL SELECT * FROM step3""",
)
def capped_subgraph(spark, sf_dir):
    seeds = B.read(spark, sf_dir, "supplier").filter("s_acctbal < -800").select(F.col("s_suppkey").alias("node"))
    return graph.capped_subgraph(graph.adjacency(B.paths(spark, sf_dir)), seeds, 3, MAX_NODES, MAX_EDGES)


@query(
    "outage_subgraph",
    f"""WITH {EDGES_SQL}, h0 AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < -800),
e1 AS (SELECT * FROM edges WHERE low IN (SELECT node FROM h0) OR high IN (SELECT node FROM h0)), h1 AS (SELECT low AS node FROM e1 UNION SELECT high FROM e1)
SELECT *, 1 AS hop FROM e1 UNION ALL SELECT *, 2 FROM edges e WHERE (low IN (SELECT node FROM h1) OR high IN (SELECT node FROM h1)) AND NOT EXISTS (SELECT 1 FROM e1 WHERE e1.low = e.low AND e1.high = e.high)""",
)
def outage_subgraph(spark, sf_dir):
    seeds = B.read(spark, sf_dir, "supplier").filter("s_acctbal < -800").select(F.col("s_suppkey").alias("node"))
    return graph.capped_subgraph(graph.adjacency(B.paths(spark, sf_dir)), seeds, 2)


@query(
    "subgraph_hops",
    f"""WITH {EDGES_SQL}, both_ways AS (SELECT low AS a, high AS b FROM edges UNION ALL SELECT high, low FROM edges),
h0 AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0), h1 AS (SELECT DISTINCT b AS node FROM h0 JOIN both_ways ON a = node EXCEPT SELECT node FROM h0),
h2 AS (SELECT DISTINCT b AS node FROM h1 JOIN both_ways ON a = node EXCEPT (SELECT node FROM h0 UNION SELECT node FROM h1))
SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""",
)
def subgraph_hops(spark, sf_dir):
    edges = graph.adjacency(B.paths(spark, sf_dir))
    seeds = B.read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    return graph.neighbourhood(edges, seeds, 2)


@query(
    "downstream_pairs",
    f"""WITH {B.PATH_SQL}, hops AS (SELECT path_id, unnest(string_split(as_path, ' '))::BIGINT AS h, unnest(range(len(string_split(as_path, ' ')))) AS i, len(string_split(as_path, ' ')) AS n, string_split(as_path, ' ')[-1]::BIGINT AS origin FROM path),
uses AS (SELECT DISTINCT path_id, h, origin FROM hops WHERE i < n - 1 AND h <> origin)
SELECT h AS affected, origin, count(*) AS n_paths FROM uses JOIN supplier ON s_suppkey = h AND s_acctbal < 0 GROUP BY ALL""",
)
def downstream_pairs(spark, sf_dir):
    bad = B.read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("asn"))
    return graph.downstream(B.paths(spark, sf_dir), bad)


@query(
    "path_dictionary",
    f"""WITH {B.ROUTE_SQL} SELECT 'path_' || substr(sha256(as_path), 1, 24) AS path_key, as_path, len(string_split(as_path, ' ')) AS n_hops, count(*) AS n_uses FROM route WHERE as_path IS NOT NULL GROUP BY as_path""",
)
def path_dictionary(spark, sf_dir):
    return graph.path_dictionary(B.route_events(spark, sf_dir))


@query(
    "leak_triplets",
    f"""WITH {B.PATH_SQL}, hops AS (SELECT path_id, o_custkey AS prefix, list_filter([CASE WHEN i = 1 OR h[i] <> h[i - 1] THEN h[i] END FOR i IN range(1, len(h) + 1)], lambda x: x IS NOT NULL) AS h
  FROM (SELECT path_id, string_split(as_path, ' ') AS h FROM path) JOIN orders ON o_orderkey = path_id),
raw AS (SELECT DISTINCT l_suppkey::VARCHAR AS a, (l_partkey % 100 + 1)::VARCHAR AS b, CASE WHEN l_quantity > 45 THEN -1 WHEN l_quantity < 3 THEN 0 ELSE 1 END AS rel FROM lineitem WHERE l_quantity > 45 OR l_quantity < 4),
mirrored AS (SELECT a, b, rel FROM raw UNION ALL SELECT b, a, -rel FROM raw), rel AS (SELECT a, b FROM mirrored GROUP BY a, b HAVING min(CASE rel WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) = 2),
t AS (SELECT path_id, prefix, len(h) - i AS from_origin, h[i] AS first_as, h[i - 1] AS second_as, h[i - 2] AS third_as FROM hops, unnest(range(3, len(h) + 1)) AS u(i) WHERE len(h) > 3),
known AS (SELECT ps_a AS first_as, ps_b AS second_as, ps_c AS third_as, max(p) AS stability FROM (SELECT l_suppkey::VARCHAR AS ps_a, (l_partkey % 100 + 1)::VARCHAR AS ps_b, (l_orderkey % 100 + 1)::VARCHAR AS ps_c, l_discount * 4 AS p FROM lineitem) GROUP BY ALL),
found AS (SELECT t.*, row_number() OVER (PARTITION BY prefix ORDER BY path_id, from_origin) AS rn FROM t LEFT JOIN known USING (first_as, second_as, third_as)
  WHERE coalesce(stability, 0) < 0.2 AND (first_as, second_as) IN (SELECT (a, b) FROM rel) AND (third_as, second_as) IN (SELECT (a, b) FROM rel))
SELECT prefix, path_id, from_origin::INT AS from_origin, first_as, second_as, third_as FROM found WHERE rn = 1""",
)
def leak_triplets(spark, sf_dir):
    """An order's customer is the prefix, orders come in the order of their keys."""
    i = B.read(spark, sf_dir, "lineitem")
    text = lambda c: (c % 100 + 1).cast("string")
    rel = F.when(F.col("l_quantity") > 45, -1).when(F.col("l_quantity") < 3, 0).otherwise(1)
    edges = i.filter("l_quantity > 45 OR l_quantity < 4").select(F.col("l_suppkey").cast("string").alias("a"), text(F.col("l_partkey")).alias("b"), rel.alias("rel"))
    known = i.select(F.col("l_suppkey").cast("string").alias("first_as"), text(F.col("l_partkey")).alias("second_as"), text(F.col("l_orderkey")).alias("third_as"), (F.col("l_discount") * 4).cast("double").alias("stability"))
    owners = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path_id"), F.col("o_custkey").alias("prefix"))
    return state.leak_triplets(B.paths(spark, sf_dir).join(owners, "path_id"), edges, known, "as_path", ["prefix"], ["path_id"])
