"""Queries over the rule chains of origin conflicts and leaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judgements
from . import bindings as B
from .registry import query


def as_info(spark, sf_dir):
    """One row for each AS that suppliers name."""
    a = B.read(spark, sf_dir, "supplier").select((F.lit(3000) + F.col("s_suppkey") % 60).alias("n")).distinct()
    text = lambda c: c.cast("string")
    some = lambda holds, x: F.when(holds, F.array(x)).otherwise(F.array().cast("array<string>"))
    n = F.col("n")
    org = F.when(n % 15 == 0, "个人网络").when(n % 14 == 0, "未知组织").when(n % 11 != 0, F.concat(F.lit("org "), text(F.floor(n / 2))))
    return a.select(
        text(n).alias("asn"), org.alias("org"), F.when(n % 3 == 0, F.concat(F.lit("o"), text(n % 7))).alias("org_en"), (n % 23 == 0).alias("shield"), some(n % 6 == 1, F.concat(F.lit("AS"), text(n + 1))).alias("imports"),
        some(n % 8 == 5, F.concat(F.lit("AS"), text(n - 1))).alias("exports"), some(n % 9 == 0, text(n + 1)).alias("peers"), some(n % 10 == 4, text(n + 1)).alias("siblings"),
    )


INFO_SQL = """
info AS (
  SELECT n::VARCHAR AS asn, CASE WHEN n % 15 = 0 THEN '个人网络' WHEN n % 14 = 0 THEN '未知组织' WHEN n % 11 <> 0 THEN 'org ' || (n // 2) END AS org, CASE WHEN n % 3 = 0 THEN 'o' || (n % 7) END AS org_en, n % 23 = 0 AS shield,
         CASE WHEN n % 6 = 1 THEN 'AS' || (n + 1) END AS imp, CASE WHEN n % 8 = 5 THEN 'AS' || (n - 1) END AS exp, CASE WHEN n % 9 = 0 THEN (n + 1)::VARCHAR END AS peer, CASE WHEN n % 10 = 4 THEN (n + 1)::VARCHAR END AS sib
  FROM (SELECT DISTINCT 3000 + s_suppkey % 60 AS n FROM supplier))"""


def conflicts(spark, sf_dir):
    """(prefix, origins, first_origin) of prefixes with more than one origin, some of them odd."""
    r = B.route_events(spark, sf_dir).filter("action = 'announce'")
    odd = F.when(F.col("prefix_id") % 17 == 4, "{1,2}").when(F.col("prefix_id") % 19 == 5, "64600").when(F.col("prefix_id") % 23 == 6, "x1").when(F.col("prefix_id") % 29 == 7, "").otherwise("77")
    origin = F.when((F.col("event_id") % 26 == 0) & (F.col("prefix_id") % 4 == 1), odd).otherwise(F.col("origin").cast("string"))
    rows = r.select("prefix", origin.alias("origin"), "epoch_s", "event_id")
    return rows.groupBy("prefix").agg(F.sort_array(F.collect_set("origin")).alias("origins"), F.min_by("origin", F.struct("epoch_s", "event_id")).alias("first_origin")).filter("size(origins) > 1")


CONFLICT_SQL = f"""{B.ROUTE_SQL}, {INFO_SQL},
said AS (
  SELECT prefix, epoch_s, event_id, CASE WHEN event_id % 26 = 0 AND prefix_id % 4 = 1 THEN CASE WHEN prefix_id % 17 = 4 THEN '{{1,2}}' WHEN prefix_id % 19 = 5 THEN '64600' WHEN prefix_id % 23 = 6 THEN 'x1' WHEN prefix_id % 29 = 7 THEN '' ELSE '77' END
         ELSE origin::VARCHAR END AS origin FROM route WHERE action = 'announce'),
sets AS (SELECT prefix, list_sort(list(DISTINCT origin)) AS o, arg_min(origin, (epoch_s, event_id)) AS first_origin FROM said GROUP BY prefix HAVING count(DISTINCT origin) > 1),
early AS (
  SELECT *, CASE WHEN len(o) > 2 THEN 'moas num more than 2' ELSE list_filter(list_transform(o, lambda x: CASE WHEN trim(x) = '' OR NOT (regexp_full_match(trim(x), '[0-9]+') OR contains(x, '{{') OR contains(x, '_')) THEN 'invalid asn' WHEN contains(x, '{{') THEN 'as_set'
    WHEN TRY_CAST(x AS BIGINT) BETWEEN 64512 AND 65535 OR TRY_CAST(x AS BIGINT) BETWEEN 4200000000 AND 4294967294 THEN 'private as' END), lambda r: r IS NOT NULL)[1] END AS reason FROM sets),
named AS (SELECT prefix, reason, CASE WHEN reason IS NULL THEN CASE WHEN o[1] = first_origin THEN o[1] ELSE o[2] END END AS owner, CASE WHEN reason IS NULL THEN CASE WHEN o[1] = first_origin THEN o[2] ELSE o[1] END END AS suspect FROM early),
registered AS (SELECT DISTINCT prefix, (3000 + (prefix_id * 7) % 60)::VARCHAR AS asn FROM route WHERE prefix_id % 6 = 1),
history AS (SELECT DISTINCT prefix, origin::VARCHAR AS asn FROM route WHERE prefix_id % 9 = 3 AND action = 'announce'),
rel AS (SELECT (3000 + s)::VARCHAR AS a, (3001 + s)::VARCHAR AS b, s % 3 - 1 AS rel FROM (SELECT DISTINCT s_suppkey % 60 AS s FROM supplier) WHERE s % 5 = 2),
both_ways AS (SELECT a, b, min(CASE rel WHEN 0 THEN 0 ELSE 1 END) AS p FROM (SELECT a, b, rel FROM rel UNION ALL SELECT b, a, -rel FROM rel) GROUP BY a, b),
sibs AS (SELECT (3000 + s)::VARCHAR AS a, (3001 + s)::VARCHAR AS b FROM (SELECT DISTINCT s_suppkey % 60 AS s FROM supplier) WHERE s % 12 = 7), sib2 AS (SELECT a, b FROM sibs UNION SELECT b, a FROM sibs),
pairs AS (
  SELECT prefix, owner, suspect, 0 AS place, owner AS h FROM named WHERE reason IS NULL
  UNION ALL SELECT n.prefix, owner, suspect, row_number() OVER (PARTITION BY n.prefix ORDER BY asn), asn FROM named n JOIN registered r ON r.prefix = n.prefix WHERE reason IS NULL AND asn <> owner),
ruled AS (
  SELECT p.prefix, p.owner, p.suspect, p.place, CASE
    WHEN contains(coalesce(io.org, ''), '个人') OR contains(coalesce(io.org, ''), '未知') OR contains(coalesce(s.org, ''), '个人') OR contains(coalesce(s.org, ''), '未知') THEN 'personal network or unknown org'
    WHEN h.imp = 'AS' || p.suspect THEN p.h || ' import filter ' || p.suspect WHEN h.exp = 'AS' || p.suspect THEN p.h || ' export filter ' || p.suspect WHEN s.imp = 'AS' || p.h THEN p.suspect || ' import filter ' || p.h WHEN s.exp = 'AS' || p.h THEN p.suspect || ' export filter ' || p.h
    WHEN w.p = 1 THEN 'as rel provider-customer' WHEN w.p = 0 THEN 'as rel peer' WHEN x.a IS NOT NULL OR h.org_en = s.org_en THEN 'as rel same org' WHEN hb.asn IS NOT NULL AND sb.asn IS NOT NULL THEN p.prefix || 'both in moasset'
    WHEN s.shield THEN p.suspect || ' is AntiDDoS provider' WHEN h.shield THEN p.h || ' is AntiDDoS provider' WHEN s.peer IN (p.h) OR h.peer IN (p.suspect) THEN 'peer' WHEN s.sib IN (p.h) OR h.sib IN (p.suspect) THEN 'siblings' END AS rule
  FROM pairs p LEFT JOIN info io ON io.asn = p.owner LEFT JOIN info h ON h.asn = p.h LEFT JOIN info s ON s.asn = p.suspect LEFT JOIN both_ways w ON w.a = p.h AND w.b = p.suspect LEFT JOIN sib2 x ON x.a = p.h AND x.b = p.suspect
  LEFT JOIN history hb ON hb.prefix = p.prefix AND hb.asn = p.h LEFT JOIN history sb ON sb.prefix = p.prefix AND sb.asn = p.suspect)"""


@query(
    "judged_conflicts",
    f"""WITH {CONFLICT_SQL}
SELECT prefix, owner, suspect, coalesce(arg_min(rule, place) FILTER (rule IS NOT NULL), 'possible hijack') AS verdict FROM ruled GROUP BY prefix, owner, suspect UNION ALL SELECT prefix, owner, suspect, reason FROM named WHERE reason IS NOT NULL""",
)
def judged_conflicts(spark, sf_dir):
    r = B.route_events(spark, sf_dir)
    s = B.read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 60).alias("s")).distinct()
    a, b = (F.lit(3000) + F.col("s")).cast("string").alias("a"), (F.lit(3001) + F.col("s")).cast("string").alias("b")
    registered = r.filter("prefix_id % 6 = 1").select("prefix", (F.lit(3000) + F.col("prefix_id") * 7 % 60).cast("string").alias("asn")).distinct()
    history = r.filter("prefix_id % 9 = 3 AND action = 'announce'").select("prefix", F.col("origin").cast("string").alias("asn"))
    return judgements.judge_conflicts(conflicts(spark, sf_dir), as_info(spark, sf_dir), s.filter("s % 5 = 2").select(a, b, (F.col("s") % 3 - 1).cast("int").alias("rel")), s.filter("s % 12 = 7").select(a, b), registered, history)


@query(
    "judged_leaks",
    f"""WITH {INFO_SQL},
leak AS (SELECT DISTINCT CASE WHEN l_partkey % 41 = 0 THEN '{{5}}' WHEN l_partkey % 43 = 0 THEN '64511' ELSE (3000 + l_suppkey % 60)::VARCHAR END AS leak_by, (3000 + (l_suppkey + l_linenumber) % 64)::VARCHAR AS leak_to FROM lineitem)
SELECT leak_by, leak_to, CASE WHEN leak_by = leak_to THEN 'by equal to' WHEN contains(coalesce(t.org, ''), '个人') OR contains(coalesce(b.org, ''), '个人') THEN 'personal network' WHEN b.org = '未知组织' OR t.org = '未知组织' THEN 'unknown org'
  WHEN coalesce(b.org, '') = coalesce(t.org, '') THEN 'org equal' WHEN contains(leak_by, '{{') OR contains(leak_to, '{{') THEN 'as set' WHEN TRY_CAST(leak_by AS BIGINT) BETWEEN 64511 AND 65535 OR TRY_CAST(leak_to AS BIGINT) BETWEEN 64511 AND 65535 THEN 'private as'
  WHEN b.imp = 'AS' || leak_to THEN leak_by || ' import filter ' || leak_to WHEN b.exp = 'AS' || leak_to THEN leak_by || ' export filter ' || leak_to WHEN t.imp = 'AS' || leak_by THEN leak_to || ' import filter ' || leak_by WHEN t.exp = 'AS' || leak_by THEN leak_to || ' export filter ' || leak_by
  ELSE 'possible leak' END AS verdict
FROM leak LEFT JOIN info b ON b.asn = leak_by LEFT JOIN info t ON t.asn = leak_to""",
)
def judged_leaks(spark, sf_dir):
    i = B.read(spark, sf_dir, "lineitem")
    by = F.when(F.col("l_partkey") % 41 == 0, "{5}").when(F.col("l_partkey") % 43 == 0, "64511").otherwise((F.lit(3000) + F.col("l_suppkey") % 60).cast("string"))
    leaks = i.select(by.alias("leak_by"), (F.lit(3000) + (F.col("l_suppkey") + F.col("l_linenumber")) % 64).cast("string").alias("leak_to")).distinct()
    return judgements.judge_leaks(leaks, as_info(spark, sf_dir))
