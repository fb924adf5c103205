"""Queries of the column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prefixes, texts
from ..functions import scalars as S
from ..operators import joins
from . import bindings as B
from .registry import query


@query(
    "origin_asns",
    f"""WITH {B.ROUTE_SQL}, h AS (SELECT event_id, as_path, string_split(as_path, ' ') AS hops FROM route WHERE as_path IS NOT NULL)
SELECT event_id, coalesce(list_filter(hops, lambda x: NOT (x::BIGINT BETWEEN 64512 AND 65535))[-1], hops[-1]) AS origin_any, list_filter(hops, lambda x: NOT (x::BIGINT BETWEEN 64512 AND 65535))[-1] AS origin_public FROM h""",
)
def origin_asns(spark, sf_dir):
    rows = B.route_events(spark, sf_dir).filter("as_path IS NOT NULL")
    return rows.select("event_id", S.origin_asn(F.col("as_path")).alias("origin_any"), S.origin_public(F.col("as_path")).alias("origin_public"))


@query(
    "collapsed_paths",
    f"WITH {B.PATH_SQL}, h AS (SELECT path_id, [x::BIGINT // 10 FOR x IN string_split(as_path, ' ')] AS h FROM path) SELECT path_id, array_to_string([h[i] FOR i IN range(1, len(h) + 1) IF i = 1 OR h[i] <> h[i - 1]], ' ') AS collapsed FROM h",
)
def collapsed_paths(spark, sf_dir):
    short = F.transform(F.split("as_path", " "), lambda h: F.floor(h.cast("bigint") / 10).cast("string"))
    return B.paths(spark, sf_dir).select("path_id", F.array_join(S.collapse_prepends(short), " ").alias("collapsed"))


@query(
    "duration_texts",
    f"""WITH {B.OUTAGE_SQL}, d AS (SELECT event_id, end_s - start_s AS s FROM outage WHERE end_s IS NOT NULL)
SELECT event_id, concat_ws(' ', CASE WHEN s >= 86400 THEN (s // 86400) || ' days' END, CASE WHEN s >= 3600 THEN (s % 86400 // 3600) || ' hours' END, CASE WHEN s >= 60 THEN (s % 3600 // 60) || ' minutes' END, (s % 60) || ' seconds') AS text FROM d""",
)
def duration_texts(spark, sf_dir):
    return B.outages(spark, sf_dir).filter("end_s IS NOT NULL").select("event_id", S.duration_text(F.col("end_s") - F.col("start_s")).alias("text"))


@query(
    "locators",
    """WITH u AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'broken' WHEN event_id % 19 = 0 THEN event_type || '//x/1/s' ELSE event_type || '/' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '/10.0.0.0%2F8/' || user_id || '/rrc25' END AS url FROM events), p AS (SELECT *, string_split(url, '/') AS x FROM u)
SELECT event_id, CASE WHEN len(x) <> 5 THEN 'part_count' WHEN list_contains(x, '') THEN 'empty_part' END AS error, CASE WHEN len(x) = 5 AND NOT list_contains(x, '') THEN x[4]::BIGINT END AS located FROM p""",
)
def locators(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    url = F.when(F.col("event_id") % 17 == 0, "broken").when(F.col("event_id") % 19 == 0, F.concat("event_type", F.lit("//x/1/s")))
    url = url.otherwise(F.concat("event_type", F.lit("/"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("/10.0.0.0%2F8/"), F.col("user_id").cast("string"), F.lit("/rrc25")))
    parsed = e.select("event_id", S.parse_locator(url).alias("p"))
    return parsed.select("event_id", F.col("p.error").alias("error"), F.col("p.event_id").alias("located"))


@query(
    "asn_tokens",
    "WITH t AS (SELECT item_id, text FROM benchmark), x AS (SELECT event_id, 'AS' || user_id || ', as' || (user_id + 1) || ' and ' || (event_id % 70000) AS label FROM events) SELECT event_id, array_to_string(list_sort(list_distinct([z::BIGINT FOR z IN regexp_extract_all(label, '([0-9]+)', 1)])), ',') AS asns FROM x",
)
def asn_tokens(spark, sf_dir):
    label = F.concat(F.lit("AS"), F.col("user_id").cast("string"), F.lit(", as"), (F.col("user_id") + 1).cast("string"), F.lit(" and "), (F.col("event_id") % 70000).cast("string"))
    return B.read(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(S.asn_tokens(label)).cast("array<string>"), ",").alias("asns"))


@query("severity_levels", "SELECT p_partkey, CASE WHEN p_size > 30 OR p_retailprice > 1500 THEN 'high' WHEN p_size > 10 THEN 'middle' ELSE 'low' END AS level FROM part")
def severity_levels(spark, sf_dir):
    p = B.read(spark, sf_dir, "part")
    sites = F.when(F.col("p_size") > 10, F.col("p_size")).otherwise(0)
    return p.select("p_partkey", S.hijack_severity(sites, F.lit(0), F.col("p_retailprice") > 1500).alias("level"))


@query(
    "country_levels",
    f"WITH {B.OUTAGE_SQL}, c AS (SELECT country, count(DISTINCT asn) AS total, count(DISTINCT asn) FILTER (level = 'high' AND start_s % 10 = 0) AS down FROM outage GROUP BY country) SELECT country, total, down, CASE WHEN down / total >= 0.075 AND total >= 100 AND down >= 5 THEN 'high' WHEN down / total >= 0.05 AND down / total < 0.075 THEN 'middle' ELSE 'low' END AS level FROM c",
)
def country_levels(spark, sf_dir):
    o = B.outages(spark, sf_dir)
    bad = F.when((F.col("level") == "high") & (F.col("start_s") % 10 == 0), F.col("asn"))
    c = o.groupBy("country").agg(F.count_distinct("asn").alias("total"), F.count_distinct(bad).alias("down"))
    return c.withColumn("level", S.country_outage_level(F.col("total"), F.col("down")))


@query("route_ids", f"WITH {B.ROUTE_SQL} SELECT event_id, 'vp_' || substr(sha256('{{\"prefix\":\"' || prefix || '\",\"vp\":' || vp || '}}'), 1, 24) AS route_key FROM route")
def route_ids(spark, sf_dir):
    return B.route_events(spark, sf_dir).select("event_id", S.stable_id("vp", "vp", "prefix").alias("route_key"))


@query(
    "prefix_parts",
    f"WITH {B.ROUTE_SQL} SELECT event_id, (10 * 65536 + {'CAST(split_part(prefix, chr(46), 2) AS BIGINT) * 256 + CAST(split_part(prefix, chr(46), 3) AS BIGINT)'}) * 256 AS network, 24 AS length, prefix AS canonical FROM route",
)
def prefix_parts(spark, sf_dir):
    p = F.col("prefix")
    return B.route_events(spark, sf_dir).select("event_id", prefixes.v4_network(p).alias("network"), prefixes.v4_length(p).alias("length"), prefixes.v4_text(prefixes.v4_network(p), prefixes.v4_length(p)).alias("canonical"))


@query("canonical_prefixes", f"WITH {B.ROUTE_SQL} SELECT DISTINCT prefix AS given, prefix AS canonical, 4 AS afi, 24 AS plen FROM route")
def canonical_prefixes(spark, sf_dir):
    """Parsed by the Arrow function that also reads IPv6; each different text once."""
    given = B.route_events(spark, sf_dir).select(F.col("prefix").alias("given")).distinct()
    return given.withColumn("c", prefixes.parse_cidr("given")).select("given", F.col("c.prefix").alias("canonical"), F.col("c.afi").alias("afi"), F.col("c.plen").alias("plen"))


@query(
    "longest_prefix_match",
    """WITH a AS (SELECT DISTINCT (o_custkey * 7919 + o_orderkey) % 16777216 * 256 AS address FROM orders), t AS (SELECT DISTINCT (s_suppkey * 40503 % 4096) * 1048576 AS network, 12 AS length FROM supplier UNION SELECT (p_partkey * 2654435 % 65536) * 65536, 16 FROM part),
m AS (SELECT address, network, length, row_number() OVER (PARTITION BY address ORDER BY length DESC) AS rn FROM a JOIN t ON (length = 12 AND address - address % 1048576 = network) OR (length = 16 AND address - address % 65536 = network))
SELECT a.address, network, length FROM a LEFT JOIN (SELECT * FROM m WHERE rn = 1) m ON a.address = m.address""",
)
def longest_prefix_match(spark, sf_dir):
    o = B.read(spark, sf_dir, "orders").select(((F.col("o_custkey") * 7919 + F.col("o_orderkey")) % 16_777_216 * 256).alias("address")).distinct()
    s = B.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 40503 % 4096 * 1_048_576).alias("network"), F.lit(12).alias("length"))
    p = B.read(spark, sf_dir, "part").select((F.col("p_partkey") * 2_654_435 % 65536 * 65536).alias("network"), F.lit(16).alias("length"))
    return joins.longest_match(o, s.union(p).distinct(), "address")


@query("query_kinds", "WITH q AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'AS' || user_id WHEN 1 THEN 'rrc' || (user_id % 30) ELSE event_type END AS q FROM events) SELECT CASE WHEN regexp_matches(q, '^(AS|as)?[0-9]+$') THEN 'as' WHEN starts_with(q, 'rrc') THEN 'collector' ELSE 'country' END AS kind, count(*) AS n FROM q GROUP BY ALL")
def query_kinds(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    q = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("AS"), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("rrc"), (F.col("user_id") % 30).cast("string"))).otherwise(F.col("event_type"))
    return e.groupBy(S.query_kind(q).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "event_guardrails",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN '前缀中断' WHEN 'error' THEN 'leak' WHEN 'click' THEN 'AS中断' WHEN 'signup' THEN 'country_outage' ELSE event_type END AS t, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '-' WHEN 2 THEN 'NaT' ELSE ts::VARCHAR END AS z FROM events),
k AS (SELECT *, CASE t WHEN '前缀中断' THEN 'prefix_outage' WHEN 'AS中断' THEN 'as_outage' ELSE t END AS kind FROM e)
SELECT event_id, CASE WHEN kind = 'leak' THEN 'unavailable' WHEN event_id % 4 = 3 THEN 'recorded' ELSE 'unknown' END AS lifecycle_state, CASE WHEN kind = 'prefix_outage' THEN 'legacy_biased' ELSE 'detector_fact_only' END AS attribution_state,
       CASE WHEN kind IN ('as_outage', 'country_outage') THEN 'recompute_required' ELSE 'not_applicable' END AS ratio_state,
       'causal_conclusion' || CASE WHEN kind = 'leak' THEN ',event_end,duration,recovery_state,ongoing_state' WHEN kind = 'prefix_outage' THEN ',responsible_as,causal_attribution' WHEN kind IN ('as_outage', 'country_outage') THEN ',stored_ratio_as_authoritative' ELSE '' END AS blocked_claims,
       CASE WHEN kind = 'leak' THEN 'legacy_leak_lifecycle_missing' WHEN kind = 'prefix_outage' THEN 'legacy_moas_attribution_bias' WHEN kind IN ('as_outage', 'country_outage') THEN 'legacy_ratio_recompute_required' ELSE '' END AS reason_codes FROM k""",
)
def event_guardrails(spark, sf_dir):
    e = B.read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "前缀中断").when(F.col("event_type") == "error", "leak").when(F.col("event_type") == "click", "AS中断").when(F.col("event_type") == "signup", "country_outage").otherwise(F.col("event_type"))
    end = F.when(F.col("event_id") % 4 == 1, "-").when(F.col("event_id") % 4 == 2, "NaT").when(F.col("event_id") % 4 == 3, F.col("ts").cast("string"))
    g = e.select("event_id", texts.guardrails(kind, end).alias("g")).select("event_id", "g.*")
    return g.withColumns({c: F.array_join(c, ",") for c in ("blocked_claims", "reason_codes")})


@query(
    "hijack_texts",
    f"""WITH {B.ROUTE_SQL} SELECT event_id, '在北京时间 ' || epoch_s || ' , 归属于 AS ' || origin || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '(net' || vp || ' , C' || (vp % 4) || ' )' ELSE '(C' || (vp % 4) || ' )' END || ' 的前缀 ' || prefix || ' 被 AS ' || vp || '(net' || vp || ' ) 劫持。' AS text FROM route WHERE action = 'announce'""",
)
def hijack_texts(spark, sf_dir):
    r = B.route_events(spark, sf_dir).filter("action = 'announce'")
    net, country = F.concat(F.lit("net"), "vp"), F.concat(F.lit("C"), F.col("vp") % 4)
    owner = texts.named_as(F.col("origin"), F.when(F.col("event_id") % 3 == 1, net), F.when(F.col("event_id") % 3 != 0, country))
    return r.select("event_id", texts.hijack_text(F.col("epoch_s").cast("string"), owner, F.col("prefix"), texts.named_as(F.col("vp"), net, F.lit(None).cast("string"))).alias("text"))
