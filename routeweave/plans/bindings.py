"""Routing data derived from the given tables, and the same derivations as DuckDB SQL.

``events`` becomes a route-event log: a user is a prefix, ``props.k`` picks the vantage point, an ``error`` withdraws and
every other event announces a path. ``lineitem`` grouped by order becomes AS paths, ``orders`` with its items outages.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT_SECONDS = 300
VANTAGE_POINTS = 6


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, epoch_s, slot, vp, prefix_id, prefix, action, origin, as_path)."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    epoch = F.unix_timestamp("ts")
    private = F.when(F.col("event_id") % 11 == 0, F.lit(" 64512")).otherwise(F.lit(""))
    hops = F.concat_ws(" ", (F.lit(100) + F.col("k") % VANTAGE_POINTS).cast("string"), (F.lit(200) + F.col("event_id") % 9).cast("string"), (F.lit(3000) + F.col("user_id") % 40 + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)).cast("string"))
    return e.select(
        "event_id", "ts", epoch.alias("epoch_s"), (epoch - epoch % SLOT_SECONDS).alias("slot"), (F.lit(100) + F.col("k") % VANTAGE_POINTS).alias("vp"), F.col("user_id").alias("prefix_id"),
        F.concat(F.lit("10."), F.expr("(user_id div 256) % 256").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"), F.lit(".0/24")).alias("prefix"),
        F.when(F.col("event_type") == "error", "withdraw").otherwise("announce").alias("action"),
        F.when(F.col("event_type") != "error", F.lit(3000) + F.col("user_id") % 40 + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)).alias("origin"),
        F.when(F.col("event_type") != "error", F.concat(hops, private)).alias("as_path"),
    )


#: The same rows as CTE ``route``.
ROUTE_SQL = f"""
route AS (
  SELECT event_id, ts, epoch_s, epoch_s - epoch_s % {SLOT_SECONDS} AS slot, 100 + k % {VANTAGE_POINTS} AS vp, user_id AS prefix_id,
         '10.' || ((user_id // 256) % 256) || '.' || (user_id % 256) || '.0/24' AS prefix,
         CASE WHEN event_type = 'error' THEN 'withdraw' ELSE 'announce' END AS action,
         CASE WHEN event_type <> 'error' THEN 3000 + user_id % 40 + (event_id % 13 = 0)::INT END AS origin,
         CASE WHEN event_type <> 'error' THEN (100 + k % {VANTAGE_POINTS}) || ' ' || (200 + event_id % 9) || ' ' || (3000 + user_id % 40 + (event_id % 13 = 0)::INT)
              || CASE WHEN event_id % 11 = 0 THEN ' 64512' ELSE '' END END AS as_path
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s FROM events))"""


def outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, asn, country, level, start_s, end_s, amount): an order is an outage of its customer's network that ends with its last shipment; open ('O') ones have no end."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    last = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    joined = o.join(last, "o_orderkey", "left").join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    start = F.unix_timestamp("o_orderdate")
    level = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "middle").otherwise("low")
    return joined.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("asn"), F.col("n_name").alias("country"), level.alias("level"), start.alias("start_s"),
        F.when(F.col("o_orderstatus") != "O", F.greatest(F.unix_timestamp("shipped"), start)).alias("end_s"), F.col("o_totalprice").alias("amount"),
    )


OUTAGE_SQL = """
outage AS (
  SELECT o_orderkey AS event_id, o_custkey AS asn, n_name AS country,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'middle' ELSE 'low' END AS level,
         epoch(o_orderdate)::BIGINT AS start_s,
         CASE WHEN o_orderstatus <> 'O' THEN greatest(epoch(shipped)::BIGINT, epoch(o_orderdate)::BIGINT) END AS end_s, o_totalprice AS amount
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


#: Lines of orders that a task gathers to paths.
LINES_A_PART = 500_000


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, as_path): the suppliers of an order in line order as a space-joined path. The number of parts follows the lines, so that
    what a task makes of its paths does not grow with the table."""
    i = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    i = i.repartition(max(1, math.ceil(i.count() / LINES_A_PART)), "l_orderkey").groupBy(F.col("l_orderkey").alias("path_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    return i.select("path_id", F.array_join(F.transform("x", lambda s: s["l_suppkey"].cast("string")), " ").alias("as_path"))


PATH_SQL = "path AS (SELECT l_orderkey AS path_id, string_agg(l_suppkey::VARCHAR, ' ' ORDER BY l_linenumber, l_suppkey) AS as_path FROM lineitem GROUP BY 1)"
